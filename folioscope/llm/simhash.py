"""Near-duplicate documents by SimHash and pivot distance tables.

A document's fingerprint has 128 bits: signs of the summed hash bits of its word pairs. Documents are near copies when
their fingerprints differ in at most ``RADIUS`` bits and their word counts by at most a fifth.

The search is lossless at every size: each pair within ``RADIUS`` is found. The 128 bits are dealt at random to a few
parts, and each part gets a radius, so that the radii plus one add up to ``RADIUS`` + 1: two fingerprints within
``RADIUS`` are within its radius r in at least one part. In a part, every bit has a vector of r + 1 bits, and there is a
key for each nonzero vector v: the bits whose vectors have an odd product with v. The vectors of r differing bits leave
some v orthogonal to all of them, and the key of that v holds none of the differing bits (Pagh, 2016). With more
fingerprints the parts get fewer, the keys longer and more; candidates are the pairs that share a key.

The pivot distance tables only thin out candidates: by the triangle inequality two fingerprints whose distances to a
pivot differ by more than ``RADIUS`` can't be near copies. They can't make candidates, as unrelated fingerprints differ
by about 64 bits, but their distances to a pivot by 8 in standard deviation, within ``RADIUS`` almost always.

Each fingerprint is sent once for a set of keys, not for every key. Beyond ``CELL`` fingerprints a set holds keys with
common bits, each of whose values is a cell that is compared apart. A cell takes a worker some 150 bytes a fingerprint;
one that came out larger than twice ``CELL`` is compared key by key, in pieces that part no key.

Within a key, pairs are compared in the order of their word counts, as far as these are within a fifth, but for those
that are linked already, by other keys or other members. So a group of thousands costs about what its members do, and a
spanning forest of the near pairs is passed on, which keeps what is connected.

Defined results: null texts and texts without a word have no fingerprint and are never grouped; a text of one word is
fingerprinted by it; texts of any length are read whole (their word counts count up to 2**24 - 1, beyond which texts are
as long as each other); identical fingerprints are joined at once; repeated rows with one doc_id are one document, of
different texts with one doc_id the least fingerprint counts; the kept document of a group is that with the least
doc_id, so ties don't arise; extra columns, of any names, are ignored (``duplicates``) or kept (``deduplicate``); rows with a null doc_id are never grouped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, textkit

BITS, RADIUS, PIVOTS, SEED = 128, 26, 4, 20260
CELL, SETS, CROWD = 1 << 20, 32, 512
#: Pairs that are compared at a time.
BLOCK = 1 << 16
#: Rows that a task sends to the places, about; it holds them until they are sorted by place.
SENT = 1 << 20
_RANK_BITS = 24
MIN_LENGTH_RATIO = 0.8
_COUNT_BITS = 24


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 2) fingerprint halves and the word counts; texts without words have count 0."""
    prints, counts = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), np.int64)
    for at, part in textkit.chunks(texts):
        w = textkit.words(part)
        n = np.diff(w.bounds)
        counts[at : at + len(part)] = n
        if not len(w.hash):
            continue
        pair = textkit.mix(w.hash[:-1] * np.uint64(3) + w.hash[1:]) if len(w.hash) > 1 else np.zeros(0, np.uint64)
        feature = np.append(pair, np.uint64(0))
        last = w.bounds[1:][n > 0] - 1
        single = w.bounds[:-1][n == 1]
        use = np.ones(len(w.hash), bool)
        use[last] = False
        use[single] = True
        feature[single] = w.hash[single]
        feature, doc = feature[use], w.doc[use]
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        size = np.diff(np.append(starts, len(doc)))
        for half, salt in enumerate((0, 0xA5A5A5A55A5A5A5A)):
            value = textkit.mix(feature ^ np.uint64(salt)) if half else feature
            bits = np.unpackbits(value.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total = _grouped(bits, starts)
            sign = (2 * total > size[:, None]).astype(np.uint8)
            prints[at + doc[starts], half] = np.packbits(sign, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return prints, counts


def _grouped(bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows."""
    if len(starts) == 1:
        return bits.sum(axis=0, dtype=np.int64)[None]
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def references(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, (PIVOTS, 2), np.uint64) * np.uint64(2) + np.random.default_rng(
        seed + 1
    ).integers(0, 2, (PIVOTS, 2), np.uint64)


def pivot_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(fingerprints, pivots) Hamming distances, a pivot at a time."""
    out = np.zeros((len(prints), len(pivots)), np.int16)
    for k, pivot in enumerate(pivots):
        for half in range(2):
            out[:, k] += np.bitwise_count(prints[:, half] ^ pivot[half])
    return out


def near_pairs(prints: np.ndarray, words: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) are near copies: coordinates first, distances for the survivors."""
    if len(i) > BLOCK:
        return np.concatenate([near_pairs(prints, words, table, i[k : k + BLOCK], j[k : k + BLOCK]) for k in range(0, len(i), BLOCK)])
    alive = np.ones(len(i), bool)
    for column in table.T:
        alive &= np.abs(column[i] - column[j]) <= RADIUS
    at = np.flatnonzero(alive)
    left, right = i[at], j[at]
    small, large = np.minimum(words[left], words[right]), np.maximum(words[left], words[right])
    alive[at] = (hamming(prints[left], prints[right]) <= RADIUS) & (small >= MIN_LENGTH_RATIO * large)
    return alive


def radii(parts: int, radius: int = RADIUS) -> list[int]:
    """The parts' radii: of two fingerprints within radius, one part at least differs in no more bits than its own."""
    return [(radius + 1 + k) // parts - 1 for k in range(parts)]


def plan(n: int) -> int:
    """Parts for n fingerprints: those of the least work, one unit for each key and 1/8 for each candidate pair."""

    def work(parts: int) -> float:
        return sum((2.0 ** (r + 1) - 1) * (n + n * n / 2 / 2 ** (BITS / parts / 2) / 8) for r in radii(parts))

    return min(range(2, RADIUS // 2), key=work)


def key_masks(parts: int, seed: int = SEED) -> list[np.ndarray]:
    """For each part, the (keys, 2) masks of its keys."""
    rng = np.random.default_rng(seed + 2)
    out = []
    for bits, r in zip(np.array_split(rng.permutation(BITS), parts), radii(parts), strict=True):
        # Vectors are dealt out evenly; any choice of them is lossless, an even one has keys of like length.
        every = np.concatenate([rng.permutation(np.arange(1, 1 << (r + 1))) for _ in range(len(bits) // ((1 << (r + 1)) - 1) + 1)])
        odd = np.bitwise_count(np.arange(1, 1 << (r + 1))[:, None] & every[None, : len(bits)]) % 2
        rows = np.zeros((len(odd), BITS), np.uint8)
        rows[:, bits] = odd
        out.append(np.packbits(rows, axis=1, bitorder="little").view(np.uint64))
    return out


def key_sets(parts: list[np.ndarray], common: int, at_least: int = SETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(masks, prefix): the keys in sets, those of a set with the same ``common`` bits or more, which are the prefix.

    A key of fewer bits is a set of its own, with all its bits as prefix.
    """
    out = []
    most = math.ceil(sum(map(len, parts)) / at_least)
    for masks in parts:
        left = list(range(len(masks)))
        while left:
            chosen, prefix, rest = [left[0]], masks[left[0]], []
            for k in left[1:]:
                if len(chosen) < most and int(np.bitwise_count(prefix & masks[k]).sum()) >= common:
                    chosen.append(k)
                    prefix = prefix & masks[k]
                else:
                    rest.append(k)
            left = rest
            held = np.flatnonzero(np.unpackbits(prefix.view(np.uint8), bitorder="little"))[:common]
            bits = np.zeros(BITS, np.uint8)
            bits[held] = 1
            out.append((masks[chosen], np.packbits(bits, bitorder="little").view(np.uint64)))
    return out


def _linked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the least row that each row is linked with) once the pairs (a, b) are links too."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        a, b, low, high = a[apart], b[apart], np.minimum(one, two)[apart], np.maximum(one, two)[apart]
        root = np.arange(len(label), dtype=label.dtype)
        np.minimum.at(root, high, low)
        label = root[label]
        while (label[label] != label).any():
            label = label[label]


def _crowd(member: np.ndarray, label: np.ndarray, prints: np.ndarray, words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """label with the links among the members of one key, each pair compared whose members aren't linked yet."""

    # Members come in the order of their word counts; those of near copies are a stretch of it.
    own = words[member]
    first = np.searchsorted(own, own * MIN_LENGTH_RATIO * (1 - 1e-9), "left")
    last = np.searchsorted(own, own / MIN_LENGTH_RATIO * (1 + 1e-9), "right")

    def compare(some: np.ndarray, label: np.ndarray) -> np.ndarray:
        size = last[some] - first[some]
        i = np.repeat(member[some], size)
        j = member[np.arange(len(i)) - np.repeat(np.cumsum(size) - size - first[some], size)]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        near = near_pairs(prints, words, table, i, j)
        return _linked(label, i[near], j[near])

    # A few members first: in a group of copies they link nearly all, and few pairs are left.
    for at in range(8):
        if (label[member] == label[member[0]]).all():
            return label
        label = compare(np.array([at * len(member) // 8]), label)
    _, inverse, size = np.unique(label[member], return_inverse=True, return_counts=True)
    rest = np.flatnonzero(inverse != size.argmax())
    step = max(1, 200_000 // len(member))
    for low in range(0, len(rest), step):
        label = compare(rest[low : low + step], label)
    return label


def cell_edges(prints: np.ndarray, words: np.ndarray, masks: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A forest (i, least j linked with it) of the near fingerprints that share the bits of one of the masks.

    Pairs that are linked already, by keys before, aren't compared again.
    """
    order = np.argsort(words, kind="stable").astype(np.int32)
    prints, words = prints[order], words[order].astype(np.int32)
    table, rank = pivot_table(prints, pivots), np.arange(len(order), dtype=np.uint64)
    low = np.uint64((1 << _RANK_BITS) - 1)
    # Of fingerprints in the order of their words, the first that is too long for a pair with k.
    reach = np.searchsorted(words, words / MIN_LENGTH_RATIO * (1 + 1e-9), "right").astype(np.int32)
    label = np.arange(len(order), dtype=np.int32)
    for mask in masks:
        # Sorted by key, then words. Keys are hashed to 40 bits: those that collide only add candidates.
        rows = _hashed(prints, mask) & ~low | rank
        rows.sort()
        at = (rows & low).astype(np.int32)
        rows >>= np.uint64(_RANK_BITS)
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])).astype(np.int32)
        ends = np.append(starts[1:], np.int32(len(rows)))
        del rows
        large = ends - starts > CROWD
        end = np.repeat(np.where(large, starts, ends), ends - starts)
        i, lag, found, held = np.arange(len(at), dtype=np.int32), 1, [], 0
        while len(i := i[i + lag < end[i]]) and len(i := i[at[i + lag] < reach[at[i]]]):
            a, b = at[i], at[i + lag]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            near = near_pairs(prints, words, table, a, b)
            found.append(np.stack([a[near], b[near]]))
            held += found[-1].shape[1]
            # Of a group of copies most pairs are near: they are no more than the fingerprints before they are linked.
            if held > len(label) // 4:
                label, found, held = _linked(label, *np.concatenate(found, axis=1)), [], 0
            lag += 1
        if held:
            label = _linked(label, *np.concatenate(found, axis=1))
        for k in np.flatnonzero(large):
            label = _crowd(at[starts[k] : ends[k]], label, prints, words, table)
    child = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([order[child], order[label[child]]], axis=1)


def _hashed(prints: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A hash of each fingerprint's bits in the mask."""
    return textkit.mix(textkit.mix(prints[:, 0] & mask[0]) + (prints[:, 1] & mask[1]))


def _bits(prints: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The number that each fingerprint's bits in the mask are; few bits."""
    out = np.zeros(len(prints), np.int64)
    for k, bit in enumerate(np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))):
        out |= ((prints[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).view(np.int64) << k
    return out


def nodes(prints: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each different (fingerprint, word count)."""
    return textkit.mix(prints[:, 0] + textkit.mix(prints[:, 1] + counts.astype(np.uint64))).view(np.int64)


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, node, fa, fb, n) of the rows with a word."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            prints, counts = fingerprints(batch.column("text"))
            keep = np.flatnonzero(counts)
            prints, counts = prints[keep], np.minimum(counts[keep], (1 << _COUNT_BITS) - 1)
            columns = [nodes(prints, counts), *np.ascontiguousarray(prints.T).view(np.int64), counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep)), *map(pa.array, columns)],
                names=["doc_id", "node", "fa", "fb", "n"],
            )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        common.lean(batches), "doc_id long, node long, fa long, fb long, n long"
    )


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id) of every document in a group of two or more; keep_id is the group's least doc_id."""
    prints = common.durable(
        _prints(docs).groupBy("doc_id").agg(F.min(F.struct("node", "fa", "fb", "n")).alias("p")).select("doc_id", "p.*")
    )
    # One row for each fingerprint and word count; equal documents hang on it.
    known = common.durable(
        prints.groupBy("node").agg(
            *(F.first(c).alias(c) for c in ("fa", "fb", "n")), F.min("doc_id").alias("rep"), F.count("*").alias("copies")
        )
    )
    n = known.count()
    masks, pivots = key_masks(plan(n)), references()
    cells = math.ceil(math.log2(max(n / CELL, 1)))
    sets = key_sets(masks, cells)
    width = 1 << cells

    def placed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each set of keys: the number of set and cell, and the fingerprint with its word count."""
        for batch in found:
            columns = [batch.column(k) for k in ("fa", "fb", "n")]
            prints = np.stack([c.to_numpy() for c in columns[:2]], axis=1).view(np.uint64)
            for k, (_, prefix) in enumerate(sets):
                place = k * width + _bits(prints, prefix)
                yield pa.RecordBatch.from_arrays([pa.array(place), *columns], names=["place", "fa", "fb", "n"])

    def compared(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Near pairs of each place of a partition that is sorted by place; a place may go on in the next batches."""
        held: list[np.ndarray] = []

        def edges() -> Iterator[pa.RecordBatch]:
            place, rows = held[0][0, 0], np.concatenate([x[:, 1:] for x in held])
            held.clear()
            return _edges(rows, sets[place // width][0], pivots)

        for batch in found:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                if held and len(part) and held[0][0, 0] != part[0, 0]:
                    yield from edges()
                if len(part):
                    held.append(part)
        if held:
            yield from edges()

    places = _spread(known, n * len(sets)).select("fa", "fb", "n").mapInArrow(common.lean(placed), "place long, fa long, fb long, n long")
    # A partition for each place: hashes would put several into one, which a task would hold and sort together.
    parted = places.repartitionById(len(sets) * width, F.col("place").cast("int")).sortWithinPartitions("place")
    near = parted.mapInArrow(common.lean(compared), "a long, b long")
    roots = common.components(near)
    linked = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = linked.groupBy("root").agg(F.min("rep").alias("keep_id"), F.sum("copies").alias("size")).where("size > 1")
    return prints.join(linked.join(kept, "root").select("node", "keep_id"), "node").select("doc_id", "keep_id")


def _spread(known: DataFrame, sent: int) -> DataFrame:
    """known in as many partitions as leave each about ``SENT`` of the rows that are sent to places."""
    return known.repartition(max(1, math.ceil(sent / SENT)), "node")


def _pieces(prints: np.ndarray, masks: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """(rows, masks) that are compared at a time: all at once, or of too many rows about ``CELL`` that part no key."""
    if len(prints) <= 2 * CELL:
        yield slice(None), masks
        return
    for mask in masks:
        key = _hashed(prints, mask)
        order = np.argsort(key)
        key, at = key[order], 0
        while at < len(key):
            last = key[min(at + CELL, len(key)) - 1]
            # The last key's rows come with it where they begin the piece, else they begin the next.
            to = int(np.searchsorted(key, last, "left"))
            if to == at or at + CELL >= len(key):
                to = int(np.searchsorted(key, last, "right"))
            yield order[at:to], mask[None]
            at = to


def _edges(rows: np.ndarray, masks: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the nodes of a place, whose rows are (fa, fb, n)."""
    prints, words = np.ascontiguousarray(rows[:, :2]).view(np.uint64), rows[:, 2].copy()
    del rows
    for some, keys in _pieces(prints, masks):
        own, lengths = prints[some], words[some]
        ends = cell_edges(own, lengths, keys, pivots).T
        yield pa.RecordBatch.from_arrays([pa.array(nodes(own[x], lengths[x])) for x in ends], names=["a", "b"])


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id) of every document that has a near copy with a lower doc_id in its group."""
    return groups(docs).where("doc_id != keep_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, its repeated rows included; all columns are kept."""
    gone = duplicates(docs).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
