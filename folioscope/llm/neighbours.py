"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search over it answers queries.

Graph (Dong et al., 2011): every vector keeps its ``DEGREE`` nearest so far. A round introduces to each other the
neighbours of each vector, forward and reverse ones, of which at least one is new since the last round; a pair that
beats the farthest neighbour of either side replaces it. Each round is a handful of joins on vector ids: sampled links
meet at their hub, get vectors and bounds by a join on the member, and pairs go back to their ends. Rounds stop once
fewer than ``SETTLED`` of all links change. The start are the nearest within cells of random hyperplane codes, in
``TABLES`` tables; a cell too large is split by a hash, so no block grows with the data.

Search: every query holds a beam of the nearest met so far; in each hop its best links not yet expanded are joined
with the adjacency table, whose rows carry the vectors of a node's nearest, until no query has anything to expand or
nothing enters a beam. A query that is a row of the table starts from its own links, another one from its cells.

Vectors travel in half precision; the cosines reported are measured again in full. The result is approximate: recall
of the true ``K`` nearest is at least 0.9 on the test tables (README).

Defined results: rows with a null id or an unusable vector (null, empty, of an unusual length, with null or non-finite
numbers, or all zero) are no neighbours and no queries; repeated rows with one id are one; equal vectors of different
ids are neighbours with cosine 1; ties go to the lower id; a table with fewer than K + 1 vectors gives all the others;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, textkit, vectors

K, DEGREE, SAMPLE, ROUNDS, SETTLED = 10, 40, 16, 6, 0.02
CELL, TABLES, SEED = 512, 3, 11
BEAM, LINKS, EXPAND, HOPS = 192, 40, 24, 12
_GRAPH = "id long, nids array<long>, scores array<float>, used array<byte>"
_NEW, _FRESH, _USED = 0, 1, 2


def _lists(rows: pa.Array, *values: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Cuts of list arrays with flat values, as [ids, lists]."""
    unique, start = np.unique(rows, return_index=True)
    cuts = pa.array(np.append(start, len(rows)).astype(np.int32))
    return unique, [pa.ListArray.from_arrays(cuts, v) for v in values]


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _sizes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).value_lengths().to_numpy(zero_copy_only=False), np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) of a binary array of half-precision vectors of equal length."""
    if not len(column):
        return np.zeros((0, 1), np.float32)
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    return raw.view(np.float16).reshape(len(column), -1).astype(np.float32)


def _group_graph(row: np.ndarray, nid: np.ndarray, score: np.ndarray, flag: np.ndarray, most: int):
    """The entries to keep, by row: distinct neighbours, known ones before new ones, then the ``most`` best."""
    order = np.lexsort((-flag, nid, row))
    row, nid, score, flag = row[order], nid[order], score[order], flag[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (nid[1:] != nid[:-1])
    row, nid, score, flag = row[first], nid[first], score[first], flag[first]
    order = np.lexsort((nid, -score, row))
    row, nid, score, flag = row[order], nid[order], score[order], flag[order]
    start = np.searchsorted(row, row, "left")
    kept = np.arange(len(row)) - start < most
    return row[kept], nid[kept], score[kept], flag[kept]


def _merge(parts: DataFrame, most: int) -> DataFrame:
    """Rows (id, nids, scores, used), several for an id, as one row for each id with its best ``most`` entries.

    ``changed`` counts the new entries among them, which are fresh from now on.
    """
    grouped = parts.groupBy("id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("nids", "scores", "used")])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            row = np.repeat(np.arange(batch.num_rows), _sizes(batch, "nids"))
            row, nid, score, flag = _group_graph(row, _flat(batch, "nids"), _flat(batch, "scores"), _flat(batch, "used"), most)
            cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            changed = np.bincount(row, flag == _NEW, batch.num_rows).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (nid, score.astype(np.float32), np.maximum(flag, _FRESH).astype(np.int8))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists, pa.array(changed)], names=["id", "nids", "scores", "used", "changed"])

    return grouped.mapInArrow(batches, _GRAPH + ", changed int")


def _codes(dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(TABLES, bits, dim)).astype(np.float32)


def _placed(points: DataFrame, dim: int, bits: int) -> DataFrame:
    """(id, vec, tab, code): each point once for each table of hyperplane codes."""
    planes = _codes(dim, bits)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = _vectors(batch.column("vec"))
            for t in range(TABLES):
                code = ((x @ planes[t].T > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vec"), pa.array(np.full(len(x), t, np.int32)), pa.array(code)],
                    names=["id", "vec", "tab", "code"],
                )

    return points.select("id", "vec").mapInArrow(batches, "id long, vec binary, tab int, code long")


def _start(placed: DataFrame, degree: int, cell: int) -> DataFrame:
    """The nearest within cells."""
    load = placed.groupBy("tab", "code").agg(F.ceil(F.count("*") / (2 * cell)).alias("parts"))
    cells = placed.join(load, ["tab", "code"]).withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.col("parts")))

    def near(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks()
        ids = batch.column("id").to_numpy()
        x = _vectors(pa.concat_arrays(batch.column("vec").chunks))
        n, keep = len(ids), min(degree, len(ids) - 1)
        if keep < 1:
            lists = [pa.array([[]] * n, pa.list_(k)) for k in (pa.int64(), pa.float32(), pa.int8())]
        else:
            g = x @ x.T
            np.fill_diagonal(g, -9)
            best = np.argpartition(-g, keep - 1, axis=1)[:, :keep]
            cuts = pa.array(np.arange(n + 1, dtype=np.int32) * keep)
            flat = (ids[best].ravel(), np.take_along_axis(g, best, 1).ravel(), np.zeros(n * keep, np.int8))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in flat]
        return pa.Table.from_arrays([pa.array(ids), *lists], names=["id", "nids", "scores", "used"])

    return cells.select("id", "vec", "tab", "code", "part").groupBy("tab", "code", "part").applyInArrow(near, _GRAPH)


def _chosen(row: np.ndarray, key: np.ndarray, used: np.ndarray, turn: int, most: int) -> np.ndarray:
    """Of each row at most ``most`` fresh and as many used entries, by a seeded hash of the entry."""
    mark = textkit.mix(key.astype(np.uint64) * np.uint64(2 * turn + 3) + np.uint64(SEED))
    order = np.lexsort((mark, used, row))
    r, u = row[order], used[order]
    begin = np.ones(len(r), bool)
    begin[1:] = (r[1:] != r[:-1]) | (u[1:] != u[:-1])
    at = np.arange(len(r))
    rank = at - np.maximum.accumulate(np.where(begin, at, 0))
    out = np.zeros(len(row), bool)
    out[order[rank < most]] = True
    return out


def _round(graph: DataFrame, points: DataFrame, degree: int, sample: int, turn: int) -> DataFrame:
    """The graph after neighbours of neighbours have met."""

    def links(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            row, nid, used = np.repeat(np.arange(batch.num_rows), _sizes(batch, "nids")), _flat(batch, "nids"), _flat(batch, "used")
            take = _chosen(row, nid, used, turn, sample)
            hub, member, fresh = batch.column("id").to_numpy()[row[take]], nid[take], used[take] == _FRESH
            # Of the links back to a hub those with the lowest hashes are taken in the end: the lowest of a batch do.
            order = np.argsort(member, kind="stable")
            low = order[_chosen(member[order], hub[order], fresh[order] * 2 + 1, turn, sample)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v)) for v in ((hub, member[low]), (member, hub[low]), (fresh, fresh[low]), (np.zeros(len(hub), bool), np.ones(len(low), bool)))],
                names=["hub", "member", "fresh", "back"],
            )

    def members(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            size, both = _sizes(batch, "all"), batch.column("all").flatten()
            row = np.repeat(np.arange(batch.num_rows), size)
            member, fresh, back = (both.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            take = ~back | _chosen(row, member, fresh * 2 + back.astype(np.int8), turn, sample)
            row, member, fresh = row[take], member[take], fresh[take]
            order = np.lexsort((~fresh, member, row))
            row, member, fresh = row[order], member[order], fresh[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (member[1:] != member[:-1])
            first &= np.bincount(row, fresh, batch.num_rows)[row] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("hub").to_numpy()[row[first]]), pa.array(member[first]), pa.array(fresh[first])],
                names=["hub", "member", "fresh"],
            )

    def meet(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            cuts, both = np.append(0, np.cumsum(_sizes(batch, "all"))), batch.column("all").flatten()
            member, fresh, bound = (both.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            x, held = _vectors(both.field(3)), []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                m, f, b = member[low:high], fresh[low:high], bound[low:high]
                g = x[low:high] @ x[low:high].T
                i, j = np.nonzero((g > b[:, None]) & (f[:, None] | f[None, :]))
                apart = m[i] != m[j]
                i, j = i[apart], j[apart]
                held.append((m[i], m[j], g[i, j]))
            if not held:
                continue
            a, b, v = (np.concatenate(c) for c in zip(*held, strict=True))
            a, b, v, flag = _group_graph(a, b, v, np.zeros(len(a), np.int8), degree)
            ids, lists = _lists(a, pa.array(b), pa.array(v.astype(np.float32)), pa.array(flag))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *lists], names=["id", "nids", "scores", "used"])

    def mark(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            row, nid, used = np.repeat(np.arange(batch.num_rows), _sizes(batch, "nids")), _flat(batch, "nids"), _flat(batch, "used")
            used = np.where(_chosen(row, nid, used, turn, sample), _USED, used).astype(np.int8)
            cuts = pa.array(np.append(0, np.cumsum(_sizes(batch, "nids"))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("nids"), batch.column("scores"), pa.ListArray.from_arrays(cuts, pa.array(used))],
                names=["id", "nids", "scores", "used"],
            )

    graph = graph.select("id", "nids", "scores", "used")
    bound = F.when(F.size("scores") >= degree, F.element_at("scores", -1)).otherwise(F.lit(-2.0)).cast("float")
    known = graph.select("id", bound.alias("bound")).join(points.select("id", "vec"), "id").withColumnRenamed("id", "member")
    hubs = graph.mapInArrow(links, "hub long, member long, fresh boolean, back boolean")
    hubs = hubs.groupBy("hub").agg(F.collect_list(F.struct("member", "fresh", "back")).alias("all"))
    pairs = hubs.mapInArrow(members, "hub long, member long, fresh boolean").join(known, "member")
    met = pairs.groupBy("hub").agg(F.collect_list(F.struct("member", "fresh", "bound", "vec")).alias("all")).mapInArrow(meet, _GRAPH)
    return _merge(graph.mapInArrow(mark, _GRAPH).unionByName(met), degree)


def _points(frame: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vec, exact): unit vectors in half and single precision."""
    clean = vectors.clean(frame, key, column)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = vectors.matrix(batch.column("vec")) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()),
                    pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()),
                ],
                names=["id", "vec", "exact"],
            )

    return common.durable(clean.mapInArrow(batches, "id long, vec binary, exact binary"))


def descend(
    points: DataFrame, degree: int = DEGREE, sample: int = SAMPLE, rounds: int = ROUNDS, settled: float = SETTLED, cell: int = CELL
) -> DataFrame:
    """(id, nids, scores, used, changed): the neighbour graph of points, nearest first."""
    n = points.count()
    if not n:
        return points.sparkSession.createDataFrame([], _GRAPH + ", changed int")
    bits, dim = max(0, math.ceil(math.log2(max(1, n / cell)))), len(points.first()["vec"]) // 2
    graph = common.durable(_merge(_start(_placed(points, dim, bits), degree, cell), degree))
    for turn in range(rounds):
        graph = common.durable(_round(graph, points, degree, sample, turn))
        common.release(graph)
        if graph.agg(F.sum("changed")).first()[0] <= settled * n * degree:
            break
    return graph


def search(
    points: DataFrame, graph: DataFrame, starts: DataFrame, queries: DataFrame, beam: int = BEAM, links: int = LINKS,
    expand: int = EXPAND, hops: int = HOPS,
) -> DataFrame:
    """(id, nids, scores, ..): the beam of each query (id, vec) after greedy search from its ``starts`` (a graph's rows)."""
    near = graph.select("id", F.explode(F.slice("nids", 1, links)).alias("nid"))
    adjacency = common.durable(
        near.join(points.select(F.col("id").alias("nid"), "vec"), "nid").groupBy("id")
        .agg(F.collect_list(F.struct("nid", "vec")).alias("all")).withColumnRenamed("id", "node")
    )

    def frontier(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            size = _sizes(batch, "nids")
            row, nid, used, score = np.repeat(np.arange(batch.num_rows), size), _flat(batch, "nids"), _flat(batch, "used"), _flat(batch, "scores")
            open_ = np.flatnonzero(used != _USED)
            rank = np.arange(len(open_)) - np.searchsorted(row[open_], row[open_], "left")
            take = open_[rank < expand]
            last = np.where(size >= beam, score[np.maximum(np.cumsum(size) - 1, 0)] if len(score) else -2.0, -2.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("id").to_numpy()[row[take]]), pa.array(nid[take]), pa.array(last[row[take]].astype(np.float32))],
                names=["id", "node", "bound"],
            )

    def closed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            size, used = _sizes(batch, "nids"), _flat(batch, "used").copy()
            row = np.repeat(np.arange(batch.num_rows), size)
            open_ = np.flatnonzero(used != _USED)
            rank = np.arange(len(open_)) - np.searchsorted(row[open_], row[open_], "left")
            used[open_[rank < expand]] = _USED
            cuts = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("nids"), batch.column("scores"), pa.ListArray.from_arrays(cuts, pa.array(used.astype(np.int8)))],
                names=["id", "nids", "scores", "used"],
            )

    def visit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            ids, bound, size = batch.column("id").to_numpy(), batch.column("bound").to_numpy(), _sizes(batch, "all")
            both, q = batch.column("all").flatten(), _vectors(batch.column("qvec"))
            row = np.repeat(np.arange(batch.num_rows), size)
            nid, score = both.field(0).to_numpy(zero_copy_only=False), np.einsum("ij,ij->i", _vectors(both.field(1)), q[row]) if len(row) else np.zeros(0, np.float32)
            better = (score > bound[row]) & (nid != ids[row])
            a, b, v, flag = _group_graph(ids[row][better], nid[better], score[better], np.zeros(int(better.sum()), np.int8), beam)
            who, lists = _lists(a, pa.array(b), pa.array(v.astype(np.float32)), pa.array(flag))
            yield pa.RecordBatch.from_arrays([pa.array(who), *lists], names=["id", "nids", "scores", "used"])

    fresh = F.transform("nids", lambda _: F.lit(_FRESH).cast("byte"))
    state = common.durable(starts.select("id", F.slice("nids", 1, beam).alias("nids"), F.slice("scores", 1, beam).alias("scores"), F.slice(fresh, 1, beam).alias("used")))
    asked = queries.select("id", F.col("vec").alias("qvec"))
    for _ in range(hops):
        edge = state.mapInArrow(frontier, "id long, node long, bound float").join(asked, "id").join(adjacency, "node")
        # A visited node's vectors stay with it; only queries travel to the nodes.
        seen = edge.select("id", "bound", "qvec", "all").mapInArrow(visit, _GRAPH)
        state = common.durable(_merge(state.select("id", "nids", "scores", "used").mapInArrow(closed, _GRAPH).unionByName(seen), beam))
        common.release(state)
        if state.agg(F.sum("changed")).first()[0] <= SETTLED * state.count():
            break
    return state


def entries(points: DataFrame, queries: DataFrame, n: int, dim: int, each: int = 4, cell: int = CELL) -> DataFrame:
    """Starts of queries that are no rows of the table: points of their cells, and a few of the whole table."""
    bits = max(0, math.ceil(math.log2(max(1, n / cell))))
    held = _placed(points, dim, bits).groupBy("tab", "code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, each).alias("own"))
    few = [r["id"] for r in points.select("id").orderBy(F.xxhash64(F.lit(SEED), "id")).limit(each).collect()]
    cells = _placed(queries, dim, bits).select("id", "tab", "code").join(held, ["tab", "code"], "left")
    nids = F.array_distinct(F.concat(F.flatten(F.collect_list("own")), F.array(*[F.lit(x).cast("long") for x in few])))
    # Scores come with the first hop; until then an entry is as far as can be.
    return cells.groupBy("id").agg(nids.alias("nids")).withColumn("scores", F.transform("nids", lambda _: F.lit(-2.0).cast("float")))


def _report(state: DataFrame, points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine), measured in full precision."""
    pairs = state.select("id", F.explode(F.slice("nids", 1, k)).alias("nid"))
    pairs = pairs.join(points.select(F.col("id").alias("nid"), F.col("exact").alias("b")), "nid").join(queries.select("id", F.col("exact").alias("a")), "id")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            a, b = (np.stack([np.frombuffer(v, np.float32) for v in batch.column(c).to_pylist()]) if batch.num_rows else np.zeros((0, 1)) for c in "ab")
            value = np.round(np.clip(np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)), -1, 1), 4)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("nid"), pa.array(value)], names=["vec_id", "neighbour_id", "cosine"])

    scored = pairs.select("id", "nid", "a", "b").mapInArrow(batches, "vec_id long, neighbour_id long, cosine double")
    ranked = scored.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour_id"))).alias("all"))
    return ranked.select("vec_id", F.posexplode("all").alias("rank", "one")).select(
        "vec_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("one.neighbour_id").alias("neighbour_id"), (-F.col("one.far")).alias("cosine")
    )


def nearest(
    frame: DataFrame, k: int = K, key: str = "vec_id", column: str = "embedding", degree: int = DEGREE, every: int = 1, **options
) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): the k nearest others, among all rows, of the rows whose id ``every`` divides.

    ``options`` are those of ``descend``.
    """
    points = _points(frame, key, column)
    graph = descend(points, degree, **options)
    asked = points.where(F.col("id") % every == 0)
    starts = graph.where(F.col("id") % every == 0)
    state = search(points, graph, starts, asked) if graph.count() else graph
    return _report(state, points, asked, k)


def lookup(frame: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", column: str = "embedding", degree: int = DEGREE) -> DataFrame:
    """The k nearest rows of ``frame`` for every row of another table with the same columns, whose ids are apart."""
    points, asked = _points(frame, key, column), _points(queries, key, column)
    n = points.count()
    if not n or asked.isEmpty():
        return _report(points.sparkSession.createDataFrame([], _GRAPH), points, asked, k)
    graph = descend(points, degree)
    dim = len(points.first()["vec"]) // 2
    return _report(search(points, graph, entries(points, asked, n, dim), asked, hops=4 * HOPS), points, asked, k)
