"""Language-model scoring from a log-frequency Bloom filter.

Counts of all word unigrams and bigrams of the corpus are quantised on a logarithmic scale (Talbot and Osborne, 2007):
an n-gram with level q is put into a Bloom filter q times, as (n-gram, 1) .. (n-gram, q). A lookup probes (n-gram, 1),
(n-gram, 2), .. until one is absent, so an n-gram is never held rarer than it is, and is held q levels more frequent
only if q false positives follow on each other. The bits of an entry lie in one 64-bit word. Probabilities are
interpolated, with Witten-Bell weights for histories:

    p(w | v) = l(v) c(v w) / c(v) + (1 - l(v)) p(w),    l(v) = c(v) / (c(v) + MU),
    p(w) = (c(w) + 1) / (words + types + 1)

A document of the corpus that the model was trained on is scored by the rest of it: what it holds itself is taken off
the counts (``own``), so a text that occurs nowhere else scores as an unseen one and a copy as a known one.

Training is one shuffle: a worker adds up the n-grams of a few million words, sorts them by hash and sends each segment
of hashes as one block of differences; the segment's task adds the blocks up and fills the segment's part of the filter.
Segments are as many as the corpus is large, so each is bounded. A filter below ``BROADCAST_BYTES`` is broadcast whole
to the workers, and documents are scored in one pass. A larger one stays in segments: the distinct n-grams of a pack of
documents go to the segments, the levels come back to the pack; the scores are exactly the same.

Defined results: null and empty texts have no words, log probability 0 and perplexity null; texts of any length are
counted and scored whole; a first word is scored by its unigram; repeated rows are counted and scored each, and are
copies of each other; ties don't arise; extra columns, of any names, are ignored; an empty table gives an empty result;
rows with a null doc_id are counted and scored like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common, textkit

#: Levels of the logarithmic scale: counts up to 2 ** (q - 1) have level q.
LEVELS, MU = 48, 5.0
BITS_PER_ENTRY, PROBES = 10, 4
BROADCAST_BYTES = 128 << 20
#: Text for each segment; words that are added up, or that form a pack, at a time.
SEGMENT_TEXT, PACK_WORDS = 16 << 20, 1_500_000
_BIGRAM, _DOC = np.uint64(0x632BE59BD9B4E019), np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = 0x9E3779B97F4A7C15


def levels(counts: np.ndarray) -> np.ndarray:
    """The level of a count: 1 for a single occurrence, one more for each doubling, rounded up."""
    q = 1 + np.ceil(np.log2(np.maximum(counts, 1)) - 1e-9)
    return np.minimum(q, LEVELS).astype(np.int64)


def expected(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range; 0 for level 0. Exact for counts of 1 and 2."""
    return _EXPECTED[q]


_EXPECTED = np.array([0.0, 1.0, 2.0, *((2.0 ** (q - 2) + 1 + 2.0 ** (q - 1)) / 2 for q in range(3, LEVELS + 1))])


def ngrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, text of each word, unigram hash, bigram hash with the word before or 0), chunk by chunk."""
    for at, part in textkit.chunks(texts):
        w = textkit.words(part)
        pair = np.zeros(len(w.hash), np.uint64)
        if len(w.hash) > 1:
            pair[1:] = textkit.mix(w.hash[:-1] * _BIGRAM + w.hash[1:]) | np.uint64(1)
            pair[w.bounds[:-1][np.diff(w.bounds) > 0]] = 0
        yield at, len(part), w.doc, w.hash & ~np.uint64(1), pair


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    """Segments cut the range of hashes evenly, so that sorted n-grams are sorted by segment."""
    return (((grams >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def pack_sorted(grams: np.ndarray) -> bytes:
    """Ascending distinct hashes as differences, in as few bytes as the largest difference takes."""
    gaps = np.diff(grams, prepend=np.uint64(0))
    first, rest = gaps[:1], gaps[1:]
    wide = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    body = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :wide])
    return bytes([wide]) + first.tobytes() + body.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    wide, first = data[0], np.frombuffer(data, np.uint64, 1, 1)
    body = np.frombuffer(data, np.uint8, -1, 9).reshape(-1, wide)
    gaps = np.zeros((len(body) + 1, 8), np.uint8)
    gaps[1:, :wide] = body
    out = gaps.view(np.uint64)[:, 0]
    out[0] = first[0]
    return np.cumsum(out, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those above 254 follow in eight bytes."""
    large = counts > 254
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, -1, n) if len(data) > n else 0
    return counts


def _cuts(grams: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """(segment, slice) of ascending n-grams."""
    part = segment_of(grams, segments)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=False):
        yield int(part[low]), slice(low, high)


class Filter:
    """A Bloom filter over (n-gram, level): 64-bit words, ``sizes`` of them for each segment from ``first`` on."""

    def __init__(self, segments: int, sizes: np.ndarray, data: np.ndarray | None = None, first: int = 0):
        self.segments, self.first, self.sizes = segments, first, np.asarray(sizes, np.int64)
        self.base = np.cumsum(self.sizes) - self.sizes
        self.data = np.zeros(int(self.sizes.sum()), np.uint64) if data is None else data

    def _places(self, grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The word of each entry, and its bits in it."""
        base = textkit.mix(grams + np.uint64(level * _STEP & (1 << 64) - 1))
        bits = np.uint64(1) << (base & np.uint64(63))
        for k in range(1, PROBES):
            bits |= np.uint64(1) << ((base >> np.uint64(6 * k)) & np.uint64(63))
        spread = base >> np.uint64(32)
        if len(self.sizes) == 1:
            return (spread * np.uint64(self.sizes[0]) >> np.uint64(32)).astype(np.int64), bits
        own = segment_of(grams, self.segments) - self.first
        return self.base[own] + (spread * self.sizes[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64), bits

    def add(self, grams: np.ndarray, q: np.ndarray) -> None:
        for level in range(1, int(q.max()) + 1 if len(q) else 0):
            at, bits = self._places(grams[q >= level], level)
            np.bitwise_or.at(self.data, at, bits)

    def level(self, grams: np.ndarray) -> np.ndarray:
        """The number of levels present from the first on, by repeated probes."""
        out = np.zeros(len(grams), np.int64)
        alive = np.arange(len(grams))
        for q in range(1, LEVELS + 1):
            at, bits = self._places(grams[alive] if q > 1 else grams, q)
            alive = alive[self.data[at] & bits == bits]
            if not len(alive):
                break
            out[alive] = q
        return out


class Model:
    """Segments of the filter as a table (segment, entries, words, types, bits), with corpus totals."""

    def __init__(self, table: DataFrame, segments: int):
        self.table, self.segments = table, segments
        row = table.agg(F.sum("words"), F.sum("types"), F.sum(F.length("bits"))).first()
        self.words, self.types, self.size = (int(x or 0) for x in row)

    def whole(self) -> Filter:
        """All segments in one. Only for a filter whose size was checked."""
        sizes, data = np.ones(self.segments, np.int64), {}
        for r in self.table.select("segment", "bits").toLocalIterator():
            data[r.segment] = np.frombuffer(r.bits, np.uint64)
            sizes[r.segment] = len(data[r.segment])
        out = Filter(self.segments, sizes)
        for s, part in data.items():
            out.data[out.base[s] : out.base[s] + len(part)] = part
        return out


def _placed(df: DataFrame, parts: int, key: str, *order: str) -> DataFrame:
    """df with the rows of a key in one partition, together and in order; keys are dealt out evenly."""
    return df.repartitionById(parts, F.pmod(F.col(key), F.lit(parts)).cast("int")).sortWithinPartitions(key, *order)


def _tasks(df: DataFrame, segments: int) -> int:
    return max(1, min(segments, max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments // 8)))


def train(docs: DataFrame, segment_text: int = SEGMENT_TEXT, bits_per_entry: int = BITS_PER_ENTRY) -> Model:
    """The filter of all n-grams of docs; what it holds grows with the corpus."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, math.ceil(size / segment_text))

    def tally(held: list[np.ndarray]) -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        rows = [(s, pack_sorted(gram[own]), pack_counts(n[own])) for s, own in _cuts(gram, segments)]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["segment", "grams", "counts"])

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in found:
            for _, _, _, one, two in ngrams(batch.column("text")):
                held += [one, two[two != 0]]
                size += len(one)
                if size > PACK_WORDS:
                    yield tally(held)
                    size = 0
        if size:
            yield tally(held)

    def filled(segment: int, blocks: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, n = np.concatenate([g for g, _ in blocks]), np.concatenate([c for _, c in blocks])
        blocks.clear()
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        gram, n = gram[first], np.add.reduceat(n, first)
        q, uni = levels(n), gram & np.uint64(1) == 0
        entries = int(q.sum())
        bloom = Filter(1, np.array([math.ceil(entries * bits_per_entry / 64) + 1]), first=0)
        bloom.add(gram, q)
        row = (segment, entries, int(n[uni].sum()), int(uni.sum()), bloom.data.tobytes())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["segment", "entries", "words", "types", "bits"])

    def fill(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = -1, []
        for batch in found:
            for s, grams, counts in zip(*(batch.column(k).to_pylist() for k in ("segment", "grams", "counts")), strict=True):
                if blocks and s != at:
                    yield filled(at, blocks)
                at, gram = s, unpack_sorted(grams)
                blocks.append((gram, unpack_counts(counts, len(gram))))
        if blocks:
            yield filled(at, blocks)

    sent = docs.select("text").mapInArrow(count, "segment long, grams binary, counts binary")
    table = common.durable(
        _placed(sent, _tasks(docs, segments), "segment").mapInArrow(fill, "segment long, entries long, words long, types long, bits binary")
    )
    del sent
    common.release(table)
    return Model(table, segments)


def _repeats(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in its own document."""
    _, inverse, n = np.unique(gram ^ textkit.mix(doc.astype(np.uint64) * _DOC), return_inverse=True, return_counts=True)
    return n[inverse]


def _sums(
    doc: np.ndarray, rows: int, q_word: np.ndarray, q_pair: np.ndarray, paired: np.ndarray, one: np.ndarray, two: np.ndarray, model: tuple[int, int, bool]
) -> tuple[np.ndarray, np.ndarray]:
    """(words, log probability) of each document. ``one`` and ``two`` identify n-grams, ``paired`` has a word before."""
    words, types, own = model
    n = np.bincount(doc, minlength=rows)
    word, pair, all_words = expected(q_word), expected(q_pair), np.full(len(doc), float(words))
    if own:
        word = np.maximum(word - _repeats(doc, one), 0)
        pair[paired] = np.maximum(pair[paired] - _repeats(doc[paired], two[paired]), 0)
        all_words = np.maximum(all_words - n[doc], 0)
    history = np.where(paired, np.append(0, word[:-1]), 0) if len(word) else word
    unigram = (word + 1) / (all_words + types + 1)
    share = history / (history + MU)
    bigram = np.divide(pair, history, out=np.zeros(len(word)), where=history > 0)
    p = np.log(share * np.minimum(bigram, 1) + (1 - share) * unigram)
    return n, np.bincount(doc, p, rows)


_SCHEMA = "doc_id long, n_words long, log_prob double, perplexity double"


def _rows(ids: pa.Array, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    total = np.round(total, 6) + 0.0
    perplexity = np.round(np.exp(np.minimum(-total / np.maximum(n, 1), 700)), 6)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n.astype(np.int64)), pa.array(total), pa.array(perplexity, mask=n == 0)],
        names=["doc_id", "n_words", "log_prob", "perplexity"],
    )


def score(docs: DataFrame, model: Model, broadcast_bytes: int = BROADCAST_BYTES, own: bool = True) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row; ``own``: docs are what the model was trained on."""
    totals = (model.words, model.types, own)
    if model.size <= broadcast_bytes:
        return _score_whole(docs, model, totals)
    return _score_segments(docs, model, totals)


def _score_whole(docs: DataFrame, model: Model, totals: tuple[int, int, bool]) -> DataFrame:
    bloom = model.whole()
    shared = docs.sparkSession.sparkContext.broadcast((bloom.segments, bloom.sizes, bloom.data))
    del bloom

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Filter(*shared.value)
        for batch in found:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, rows, doc, one, two in ngrams(batch.column("text")):
                if not len(one):
                    continue
                unique, inverse = np.unique(one, return_inverse=True)
                q_pair = np.zeros(len(two), np.int64)
                paired = two != 0
                q_pair[paired] = bloom.level(two[paired])
                own = slice(at, at + rows)
                n[own], total[own] = _sums(doc, rows, bloom.level(unique)[inverse], q_pair, paired, one, two, totals)
            yield _rows(batch.column("doc_id"), n, total)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, _SCHEMA)


_LEVELS_OF, _PACK = 1, 2


def _score_segments(docs: DataFrame, model: Model, totals: tuple[int, int, bool]) -> DataFrame:
    """Scores by sending packs of n-grams to the segments that hold them, for filters too large to broadcast.

    A pack's documents travel beside its n-grams, as the places of their words in the sorted n-grams, so that both come
    from one reading of the texts.
    """
    segments = model.segments
    names = ["place", "kind", "pack", "data"]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def packed(pack: int, ids: list, sizes: list[np.ndarray], ones: list[np.ndarray], twos: list[np.ndarray]) -> pa.RecordBatch:
        one, two = np.concatenate(ones), np.concatenate(twos)
        gram, inverse = np.unique(np.concatenate([one, two[two != 0]]), return_inverse=True)
        size, known = np.concatenate(sizes), np.array([x is not None for x in ids])
        ids_ = np.array([x or 0 for x in ids], np.int64)
        body = [np.array([len(ids), len(one), len(inverse)], np.int64), ids_, size.astype(np.int64), known.astype(np.int64), inverse.astype(np.int32), (two != 0).astype(np.int32)]
        data = b"".join(x.tobytes() for x in body)
        rows = [(s, _LEVELS_OF, pack, pack_sorted(gram[own])) for s, own in _cuts(gram, segments)]
        return rows_of([*rows, (pack % segments, _PACK, pack, len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True))])

    def packs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, ones, twos = [], [], [], []
        pack = TaskContext.get().partitionId() << 32
        for batch in found:
            own = batch.column("doc_id").to_pylist()
            for at, rows, doc, one, two in ngrams(batch.column("text")):
                ids += own[at : at + rows]
                sizes.append(np.bincount(doc, minlength=rows))
                ones.append(one)
                twos.append(two)
                if sum(map(len, ones)) > PACK_WORDS:
                    yield packed(pack, ids, sizes, ones, twos)
                    pack += 1
                    ids, sizes, ones, twos = [], [], [], []
        if ids:
            yield packed(pack, ids, sizes, ones, twos)

    def probe(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, at = None, -1
        for batch in found:
            for s, kind, pack, data in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                if kind == 0:
                    bloom, at = Filter(1, np.array([len(data) // 8]), np.frombuffer(data, np.uint64)), s
                elif kind == _PACK:
                    yield rows_of([(s, kind, pack, data)])
                else:
                    gram = unpack_sorted(data)
                    q = bloom.level(gram) if bloom is not None and at == s else np.zeros(len(gram), np.int64)
                    yield rows_of([(s, kind, pack, q.astype(np.uint8).tobytes())])

    def sums(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in found:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind == _LEVELS_OF:
                    held.append(data)
                    continue
                q = np.frombuffer(b"".join(held), np.uint8).astype(np.int64)
                held = []
                raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
                docs_, words_, grams_ = np.frombuffer(raw, np.int64, 3)
                ids, size, known = np.frombuffer(raw, np.int64, 3 * docs_, 24).reshape(3, -1)
                inverse, paired = np.split(np.frombuffer(raw, np.int32, -1, 24 * (1 + docs_)), [grams_])
                paired = paired.astype(bool)
                two = np.zeros(words_, np.int64)
                two[paired] = inverse[words_:]
                q_pair = np.zeros(words_, np.int64)
                q_pair[paired] = q[inverse[words_:]]
                doc, one = np.repeat(np.arange(docs_), size), inverse[:words_]
                q_word = q[one] if words_ else np.zeros(0, np.int64)
                n, total = _sums(doc, docs_, q_word, q_pair, paired, one.astype(np.uint64), two.astype(np.uint64), totals)
                yield _rows(pa.array(ids, mask=known == 0), n, total)

    schema = "place long, kind int, pack long, data binary"
    parts = _tasks(docs, segments)
    held = model.table.select(F.col("segment").alias("place"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pack"), F.col("bits").alias("data"))
    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packs, schema)
    probed = _placed(held.unionByName(sent), parts, "place", "kind").mapInArrow(probe, schema)
    return _placed(probed, parts, "pack", "kind", "place").select("kind", "data").mapInArrow(sums, _SCHEMA)
