"""Sharding by balanced label propagation.

Documents are linked by the passages that they share, of two kinds: lines of at least ``MIN_CHARS`` characters, the same
but for case and outer blanks, and winnowed shingles of ``SHINGLE`` words at any place. Of each ``WINDOW`` shingles in a
row that with the least hash is taken, so a run of ``SHINGLE + WINDOW - 1`` words that two documents share, wherever it
stands in them, gives at least one link. A passage in s documents links each two of them with weight 1 / (s - 1), so a
document has the same total pull from each of its passages, however common. Passages of the very same documents are
counted as one with their number as weight. Links are never listed as pairs: labels are counted by passage and the
counts joined back, which is linear in the passages. Only counts of passages in more than one shard are: any other pulls
each of its documents to their own shard with its whole weight.

Start: documents in the order of their least passage are cut into shards of equal size. Then, in each round, half of
the documents (by a seeded hash, so that two linked ones don't just change places) ask to move to the shard that pulls
most. For two shards, as many moves are granted in one direction as in the other, those with the highest gains; room
below the capacity is shared out over the rest. No shard ever exceeds its capacity. Rounds go on until both halves in
turn were granted no move, or until ``STALE`` such turns in a row lowered the cut by less than ``TOLERANCE`` of it (the
last moves gain little, and linked documents may change places for ever); the labels of the least cut are kept.

Defined results: one row for each doc_id, of repeated rows too (their lines are united); documents without a shared
passage (null and empty texts among them) only fill up; texts are read whole, of any length; rows with a null doc_id
get no shard; ties go to the lower shard, between movers to the lower doc_id; extra columns, of any names, are ignored; an empty table gives an empty result; with fewer
documents than shards some shards are empty.
"""

from __future__ import annotations

import contextlib
import itertools
import math
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common, textkit

SHARDS, ROUNDS, SLACK, MIN_CHARS, SEED = 16, None, 0.05, 30, 3
SHINGLE, WINDOW, STALE, TOLERANCE = 6, 7, 2, 0.01
#: Documents of a passage for each salt.
HOT = 65536
#: Rows of passages that a worker holds; more go to files.
HELD = 1 << 21
_BYTE = textkit.mix(np.arange(1, 257, dtype=np.uint64))


def winnowed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, hashes) of the shingles taken, each once for a text; of short texts all."""
    out = [np.zeros((2, 0), np.uint64)]
    for at, part in textkit.chunks(texts):
        w = textkit.words(part)
        n = len(w.hash) - SHINGLE + 1
        if n < 1:
            continue
        marks = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            marks = marks * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : k + n]
        marks, doc = textkit.mix(marks), w.doc[:n]
        inside = doc == w.doc[SHINGLE - 1 :]
        taken = inside & (np.diff(w.bounds)[doc] < SHINGLE + WINDOW - 1)
        if n >= WINDOW:
            whole = np.flatnonzero(w.doc[: n - WINDOW + 1] == w.doc[SHINGLE + WINDOW - 2 :])
            taken[whole + np.lib.stride_tricks.sliding_window_view(marks, WINDOW)[whole].argmin(axis=1)] = True
        doc, marks = doc[taken], marks[taken]
        order = np.lexsort((marks, doc))
        doc, marks = doc[order], marks[order]
        first = np.append(True, (doc[1:] != doc[:-1]) | (marks[1:] != marks[:-1]))[: len(doc)]
        out.append(np.stack([(doc[first] + at).astype(np.uint64), marks[first]]))
    found = np.concatenate(out, axis=1)
    return found[0].astype(np.int64), found[1]


def long_lines(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, hashes) of lines of at least ``min_chars`` characters, in lower case, without outer blanks."""
    out = [np.zeros((2, 0), np.uint64)]
    for at, part in textkit.chunks(texts):
        raw, offsets = textkit.buffers(pc.utf8_lower(part))
        final = np.flatnonzero((raw[:-1] == 0xCF) & (raw[1:] == 0x82))
        if len(final):  # a capital sigma may be either of two small ones
            raw = raw.copy()
            raw[final + 1] = 0x83
        breaks = np.flatnonzero(raw == 10)
        doc = np.repeat(np.arange(len(part)), 1 + np.diff(np.searchsorted(breaks, offsets)))
        start, end = np.sort(np.append(offsets[:-1], breaks + 1)), np.sort(np.append(offsets[1:], breaks))
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        long = chars[end] - chars[start] >= min_chars
        doc, start, end = doc[long], start[long], end[long]
        solid = np.flatnonzero(raw != 32)
        low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
        solid = np.append(solid, len(raw))
        start, end = np.where(low < high, solid[low], end), np.where(low < high, solid[high - 1] + 1, end)
        out.append(np.stack([(doc + at).astype(np.uint64), textkit.span_hashes(_BYTE[raw], start, end)]))
    found = np.concatenate(out, axis=1)
    return found[0].astype(np.int64), found[1]


def _sent(docs: DataFrame, min_chars: int, places: int) -> DataFrame:
    """(place, rows) of all passages: packed arrays of their hashes and doc_ids, by ranges of hashes."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, ids = batch.column("text"), batch.column("doc_id").to_numpy()
            doc, marks = (np.concatenate(x) for x in zip(winnowed(texts), long_lines(texts, min_chars), strict=True))
            for low in range(0, len(marks), HELD):
                some = marks[low : low + HELD]
                place = ((some >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(place, kind="stable")
                rows = np.stack([some[order], ids[doc[low : low + HELD][order]].view(np.uint64)])
                used, first = np.unique(place[order], return_index=True)
                packs = [x.tobytes() for x in np.split(rows, first[1:], axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(packs, pa.binary())], names=["place", "rows"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(batches), "place int, rows binary")


def _signs(ids: np.ndarray) -> np.ndarray:
    """Two hashes of each doc_id, whose sums modulo 2 sign a set of documents."""
    return np.stack([textkit.mix(textkit.mix(ids ^ np.uint64(salt)) + np.uint64(salt)) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])


def _counted(rows: np.ndarray) -> np.ndarray:
    """(passage, doc_id, size, x1, x2, weight) of the passages in two documents or more, of all rows (passage, doc_id) of each.

    Of passages with the same documents the least stands for all; weight is their number.
    """
    order = np.argsort(rows[0])
    marks = rows[0][order]
    same = marks[1:] == marks[:-1]
    several = np.append(same, False) | np.append(False, same)
    marks, ids = rows[:, order[several[: len(order)]]]
    order = np.lexsort((ids, marks))
    marks, ids = marks[order], ids[order]
    other = np.append(True, marks[1:] != marks[:-1])[: len(marks)]
    fresh = other | np.append(True, ids[1:] != ids[:-1])[: len(ids)]
    marks, ids, starts = marks[fresh], ids[fresh], np.flatnonzero(other[fresh])
    size = np.diff(np.append(starts, len(marks)))
    signs = np.bitwise_xor.reduceat(_signs(ids), starts, axis=1) if len(ids) else np.zeros((2, 0), np.uint64)
    order = np.lexsort((marks[starts].view(np.int64), *signs, size))
    new = np.append(True, (np.diff(size[order]) != 0) | (signs[:, order[1:]] != signs[:, order[:-1]]).any(axis=0))[: len(order)]
    weight = np.zeros(len(size), np.uint64)
    weight[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
    group = np.repeat(np.arange(len(size)), size)
    kept = (size[group] > 1) & (weight[group] > 0)
    group, marks, ids = group[kept], marks[kept], ids[kept]
    return np.stack([marks, ids, size[group].astype(np.uint64), *signs[:, group], weight[group]])


def _split(parts: Iterable[np.ndarray], key: Callable[[np.ndarray], np.ndarray], files: list) -> None:
    """Append the rows of parts to the file that key numbers, back at their starts."""
    for part in parts:
        to = key(part)
        for k in np.unique(to):
            files[k].write(np.ascontiguousarray(part[:, to == k].T).tobytes())
    for file in files:
        file.seek(0)


def _read(file, rows: int) -> Iterator[np.ndarray]:
    while data := file.read(16 * rows):
        yield np.frombuffer(data, np.uint64).reshape(-1, 2).T


def _common(parts: Iterable[np.ndarray], limit: int, depth: int = 0) -> Iterator[np.ndarray]:
    """What _counted gives of all parts; beyond ``limit`` rows these are split over files by their passages' last bits.

    A passage that alone has more is split by its documents, to count them before they are passed on.
    """
    parts, held, n = iter(parts), [np.zeros((2, 0), np.uint64)], 0
    for part in parts:
        held.append(part)
        n += part.shape[1]
        if n > limit:
            break
    if n <= limit:
        yield _counted(np.concatenate(held, axis=1))
        return
    step = max(1, limit // 4)
    with contextlib.ExitStack() as stack:
        files = [stack.enter_context(tempfile.TemporaryFile()) for _ in range(16)]
        _split(itertools.chain(held, parts), lambda x: (x[0] >> np.uint64(4 * depth) & np.uint64(15)).astype(np.int64), files)
        held.clear()
        for file in files:
            if depth < 15:
                yield from _common(_read(file, step), limit, depth + 1)
                continue
            # All 64 bits are used up.
            by_doc, whole = [stack.enter_context(tempfile.TemporaryFile()) for _ in range(64)], stack.enter_context(tempfile.TemporaryFile())
            _split(_read(file, step), lambda x: (textkit.mix(x[1]) & np.uint64(63)).astype(np.int64), by_doc)
            size, signs = 0, np.zeros(2, np.uint64)
            for one in by_doc:
                rows = np.unique(np.concatenate([np.zeros((2, 0), np.uint64), *_read(one, step)], axis=1), axis=1)
                size, signs = size + rows.shape[1], signs ^ np.bitwise_xor.reduce(_signs(rows[1]), axis=1)
                whole.write(np.ascontiguousarray(rows.T).tobytes())
            whole.seek(0)
            for rows in _read(whole, step) if size > 1 else ():
                yield np.concatenate([rows, np.repeat(np.array([[size], *signs[:, None], [1]], np.uint64), rows.shape[1], axis=1)])


def links(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, passage, size, weight) of the passages that two documents or more share.

    Of passages with the same documents the least stands for all; weight is their number.
    """
    limit, names = HELD, ("passage", "doc_id", "size", "x1", "x2", "weight")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (np.frombuffer(x.as_buffer(), np.uint64).reshape(2, -1) for batch in found for x in batch.column("rows"))
        for rows in _common(parts, limit):
            if rows.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in rows], names=list(names))

    # One exchange by passage serves to drop repeats, to count and to sign; most passages are in one document, and only
    # the others get past the count. Rows travel in packs: one by one, their moves and sorts took most of the time.
    places = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = _sent(docs.where("doc_id is not null and text is not null"), min_chars, places)
    counted = sent.repartitionById(places, F.col("place")).select("rows").mapInArrow(
        common.lean(batches), ", ".join(f"{x} long" for x in names)
    )
    held = common.durable(counted)
    common.release(held)
    return (
        held.repartition("doc_id")
        .groupBy("doc_id", "size", "x1", "x2")
        .agg(F.min("passage").alias("passage"), F.sum("weight").alias("weight"))
        .select("doc_id", "passage", "size", "weight")
    )


def _packed(edges: DataFrame) -> DataFrame:
    """(doc_id, held, total, least): a document's passages in one row, their weight and the least of them."""
    return edges.groupBy("doc_id").agg(
        F.collect_list(F.struct("passage", "size", "weight")).alias("held"), F.sum("weight").alias("total"), F.min("passage").alias("least")
    )


def _start(ids: DataFrame, packed: DataFrame, shards: int, n: int, seed: int) -> DataFrame:
    """(doc_id, shard): equal cuts of the documents in the order of their least passages.

    The order is made of 2**18 cells, whose counts are summed up in a table of that bounded size.
    """
    least = packed.select("doc_id", "least")
    fine = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(64))
    coarse = F.pmod(F.coalesce("least", F.xxhash64(F.lit(seed), "doc_id")), F.lit(4096))
    placed = ids.join(least, "doc_id", "left").select("doc_id", (coarse * 64 + fine).alias("cell"))
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("cell", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("cell").orderBy("doc_id")) - 1
    return (
        placed.withColumn("rank", rank)
        .join(offsets, "cell")
        .select("doc_id", F.floor((F.col("before") + F.col("rank")) * shards / F.lit(n)).cast("int").alias("shard"))
    )


def _settled(labels: DataFrame) -> DataFrame:
    """labels, materialised, without the size estimate of its plan: checkpoints pass it on, and joins multiply it."""
    labels, spark = common.durable(labels), labels.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(labels._jdf.toJavaRDD(), labels._jdf.schema()), spark)


def _marked(packed: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, shard, total, passage, size, weight) of each document and passage."""
    return packed.join(labels, "doc_id").select("doc_id", "shard", "total", F.inline("held"))


def _parted(packed: DataFrame, labels: DataFrame) -> DataFrame:
    """(passage, size, weight, k, n): the n documents in shard k of the passages that are in several shards."""
    counts = _marked(packed, labels).groupBy("passage", "size", "weight", F.col("shard").alias("k")).agg(F.count("*").alias("n"))
    return counts.where("n < size")


def _weight(parted: DataFrame) -> float:
    """The weight of links between shards; all are of parted passages."""
    one = F.col("weight") * F.col("n") * (F.col("size") - F.col("n")) / (2 * (F.col("size") - 1))
    return float(parted.agg(F.sum(one)).first()[0] or 0)


def wishes(edges: DataFrame, labels: DataFrame, turn: Column | None = None) -> DataFrame:
    """(doc_id, shard, to, gain) of the linked documents, of a turn, that another shard pulls more than their own."""
    packed = _packed(edges)
    return _wishes(packed, _parted(packed, labels), labels, turn)


def _wishes(packed: DataFrame, parted: DataFrame, labels: DataFrame, turn: Column | None) -> DataFrame:
    # The rows of a passage in very many documents are spread over several salts, its few counts are sent to each.
    salts = F.ceil(F.col("size") / HOT)
    counts = parted.select("passage", "k", "n", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    asking = _marked(packed if turn is None else packed.where(turn), labels)
    own, others = F.col("k") == F.col("shard"), F.col("size") - 1
    # Own shards: what a passage doesn't pull there, as it is in others too; they have all of the rest.
    pulls = (
        asking.withColumn("salt", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), salts))
        .join(counts, ["passage", "salt"])
        .select(
            "doc_id", "shard", "total", "k", (F.col("weight") * F.when(own, F.col("n") - F.col("size")).otherwise(F.col("n")) / others).alias("pull")
        )
        .repartition("doc_id")
        .groupBy("doc_id", "shard", "total", "k")
        .agg(F.sum("pull").alias("pull"))
    )
    best = pulls.groupBy("doc_id", "shard", "total").agg(
        F.max(F.when(~own, F.struct("pull", (-F.col("k")).alias("low")))).alias("best"), F.max(F.when(own, F.col("pull"))).alias("lost")
    )
    gain = F.col("best.pull") - (F.col("total") + F.col("lost"))
    return best.select("doc_id", "shard", (-F.col("best.low")).alias("to"), gain.alias("gain")).where("gain > 1e-9")


def _granted(asked: DataFrame, labels: DataFrame, shards: int, capacity: int) -> DataFrame:
    """(doc_id, to) of the wishes that the quotas allow."""
    flow = asked.groupBy("shard", "to").agg(F.count("*").alias("n"))
    back = flow.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("n").alias("back"))
    sizes = labels.groupBy(F.col("shard").alias("to")).agg(F.count("*").alias("held"))
    quota = (
        flow.join(back, ["shard", "to"], "left")
        .join(sizes, "to", "left")
        .withColumn("swap", F.least("n", F.coalesce("back", F.lit(0))))
        .withColumn("rest", F.col("n") - F.col("swap"))
        .withColumn("room", F.lit(capacity) - F.coalesce("held", F.lit(0)))
        .withColumn("all", F.sum("rest").over(W.partitionBy("to")))
        .withColumn("share", F.when(F.col("all") > 0, F.floor(F.greatest("room", F.lit(0)) * F.col("rest") / F.col("all"))).otherwise(0))
        .select("shard", "to", (F.col("swap") + F.least("rest", "share")).alias("quota"))
        .where("quota > 0")
    )
    rank = F.row_number().over(W.partitionBy("shard", "to").orderBy(F.desc("gain"), "doc_id"))
    return asked.withColumn("rank", rank).join(quota, ["shard", "to"]).where("rank <= quota").select("doc_id", "to")


def assign(
    docs: DataFrame, shards: int = SHARDS, rounds: int | None = ROUNDS, slack: float = SLACK, min_chars: int = MIN_CHARS, seed: int = SEED,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(doc_id, shard) of every document; no shard has more than (1 + slack) n / shards documents, rounded up.

    ``rounds`` bounds the rounds; None goes on to the end. A ``tolerance`` of 0 goes on as long as the cut falls at all.
    """
    packed = common.durable(_packed(links(docs, min_chars)))
    common.release(packed)
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n = ids.count()
    if not n:
        return ids.select("doc_id", F.lit(0).alias("shard"))
    capacity = math.ceil(n * (1 + slack) / shards)
    labels = _settled(_start(ids, packed, shards, n, seed))
    parted = common.durable(_parted(packed, labels))
    best, least, stale, granted, k = labels, _weight(parted), 0, False, 0
    while rounds is None or k < rounds:
        turn = F.pmod(F.xxhash64(F.lit(seed + k // 2), "doc_id"), F.lit(2)) == k % 2
        # What is granted takes the wishes several times.
        asked = common.durable(_wishes(packed, parted, labels, turn))
        moves = common.durable(_granted(asked, labels, shards, capacity))
        if not moves.isEmpty():
            granted = True
            labels = _settled(
                labels.join(moves, "doc_id", "left").select("doc_id", F.coalesce("to", "shard").alias("shard"))
            )
            parted = common.durable(_parted(packed, labels))
        k += 1
        if k % 2 == 0 or k == rounds:
            now = _weight(parted) if granted else least
            stale = 0 if now < least * (1 - tolerance) else stale + 1
            if now < least:
                best, least = labels, now
            if not granted or stale == STALE:
                break
            granted = False
            common.release(labels)
    return best


def cut(edges: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """(weight of links between shards, weight of all links)."""
    n = edges.join(labels, "doc_id").groupBy("passage", "size", "weight", "shard").agg(F.count("*").alias("n"))
    inner = n.groupBy("passage", "size", "weight").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    every = F.col("size") / 2
    row = inner.agg(F.sum(F.col("weight") * (every - F.col("kept") / (F.col("size") - 1))), F.sum(F.col("weight") * every)).first()
    return float(row[0] or 0), float(row[1] or 0)
