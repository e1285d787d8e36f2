"""Near-duplicate classes of embeddings by dual traversal of cover trees: every link is found, copies aren't expanded.

Distance is the angle between vectors, a metric, in which "cosine at least ``COSINE``" is a ball. A tree's levels are
nested nets with halving radii, from half a turn down: each node is a point, a level's points are within the level's
radius of their parents, and every node knows its covering radius, the largest angle to a point below it. Two nodes are
left as soon as angle(centres) - radius - radius exceeds the threshold, since then no pair below them can be near. Where
angle(centres) + radius + radius is within it, all pairs below are near: they are counted and joined without a look.

Equal vectors are one class, compared once. Classes are spread over cells around reference vectors (a farthest-first net
of a bounded sample), of about ``CELL`` classes each. A class visits each later cell whose covering radius can't rule it
out. A cell and its visitors are cut into blocks of at most ``BLOCK``, and each pair of blocks that has own members of
the cell is a task: it builds both trees and traverses them together, or one with itself. Thus each pair is met once,
nothing is lost however large a cell is, and a task's memory is bounded. A task passes on one number of links for each of
its points, and a spanning forest of them, never the pairs.

How much the bounds save depends on the data. Tight groups collapse into one node and far clusters are never sent to
each other; unstructured vectors of many dimensions are all about as far from each other, no radius rules anything out,
and what remains is the blocked product of all pairs.

Defined results: rows with a null id or an unusable vector (null, empty, of an unusual length, with null or non-finite
numbers, or all zero) are left out; repeated rows with one id are one; equal vectors of different ids are linked; a
vector without a link is its own class and group; ties don't arise; extra columns, of any names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common, vectors

COSINE, CELL, BLOCK, LEAF, SEED = 0.95, 8192, 32768, 256, 5
#: Rows of the sample that reference vectors are taken from for each cell, and the most cells; larger ones are cut up.
SAMPLE, CELLS = 8, 4096
#: Slack for single-precision products; near pairs are measured again in double precision.
_EPS = 2e-5


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class Node:
    __slots__ = ("centre", "children", "points", "radius")

    def __init__(self, centre: int, points: np.ndarray, radius: float, children: list[Node]):
        self.centre, self.points, self.radius, self.children = centre, points, radius, children


def build(x: np.ndarray) -> Node | None:
    """The tree over the rows of x: nets with radii of pi / 2, pi / 4, ... ; at most LEAF points aren't split further."""
    if not len(x):
        return None
    return _split(x, 0, np.arange(len(x)), math.pi / 2)


def _split(x: np.ndarray, centre: int, points: np.ndarray, radius: float) -> Node:
    own = angle(x[points] @ x[centre])
    cover = float(own.max())
    if len(points) <= LEAF or cover < 1e-4:
        return Node(centre, points, cover, [])
    while radius >= cover:
        radius /= 2
    # The net starts with the node's own centre: levels are nested. Each block of points is measured against the net
    # so far; those left over open new centres.
    net, home = [centre], np.full(len(points), -1)
    for low in range(0, len(points), 512):
        block = points[low : low + 512]
        cosine = x[block] @ x[net].T
        best = cosine.argmax(axis=1)
        near = cosine[np.arange(len(block)), best] >= math.cos(radius)
        home[low : low + 512][near] = best[near]
        left = np.flatnonzero(~near)
        if len(left):
            among = x[block[left]] @ x[block[left]].T >= math.cos(radius)
            free = np.ones(len(left), bool)
            for k in range(len(left)):
                if free[k]:
                    taken = free & among[k]
                    taken[k] = True
                    home[low + left[taken]] = len(net)
                    net.append(int(block[left[k]]))
                    free &= ~taken
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(len(net) + 1))
    children, few = [], []
    for k, c in enumerate(net):
        below = points[order[cuts[k] : cuts[k + 1]]]
        if len(below) <= LEAF // 8:
            few.extend(below.tolist())
        else:
            children.append(_split(x, c, below, radius / 2))
    for low in range(0, len(few), 4 * LEAF):
        # Points with few others in their balls are kept in blocks, each bounded like any node.
        block = np.array(few[low : low + 4 * LEAF])
        children.append(Node(centre, block, float(angle(x[block] @ x[centre]).max()), []))
    return Node(centre, points, cover, children)


class Links:
    """What a traversal finds: for each row of x and of y the weight of its near rows, and edges that join near rows.

    Rows of y are numbered on from those of x. With ``same``, y is x, and a pair counts once for each of its rows.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray, y: np.ndarray, other: np.ndarray, cosine: float, same: bool = False):
        self.x, self.y, self.same = x, y, same
        self.small = (x.astype(np.float32), y.astype(np.float32))
        self.weight, self.other = weight.astype(np.float64), other.astype(np.float64)
        self.cosine, self.limit = cosine, math.acos(cosine)
        self.near_x, self.near_y = np.zeros(len(x)), np.zeros(len(y))
        self.shift = 0 if same else len(x)
        self.edges: list[np.ndarray] = []

    def all_near(self, p: Node, q: Node) -> None:
        if p is q and self.same:
            self.near_x[p.points] += self.weight[p.points].sum() - self.weight[p.points]
        else:
            self.near_x[p.points] += self.other[q.points].sum()
            self.near_y[q.points] += self.weight[p.points].sum()
            self._edge(np.full(len(q.points), p.centre), q.points)
        self._edge(p.points, np.full(len(p.points), q.centre))

    def compare(self, p: Node, q: Node) -> None:
        """All pairs of two leaves, in single precision first; those near the threshold are measured again."""
        a, b = self.small
        for low in range(0, len(p.points), 2048):
            rows = p.points[low : low + 2048]
            cosine = a[rows] @ b[q.points].T
            near = cosine >= self.cosine + _EPS
            i, j = np.nonzero((cosine >= self.cosine - _EPS) & ~near)
            if len(i):
                near[i, j] = np.einsum("ij,ij->i", self.x[rows[i]], self.y[q.points[j]]) >= self.cosine
            if p is q and self.same:
                near[np.arange(len(rows)), low + np.arange(len(rows))] = False
            if near.any():
                self.near_x[rows] += near @ self.other[q.points]
                if not (p is q and self.same):
                    self.near_y[q.points] += self.weight[rows] @ near
                self._joined(rows, q.points, near)

    def _joined(self, rows: np.ndarray, columns: np.ndarray, near: np.ndarray) -> None:
        """Edges that connect what near pairs connect: the pairs, or, where they are many, a star for each component."""
        if near.sum() <= 4 * sum(near.shape):
            i, j = np.nonzero(near)
            self._edge(rows[i], columns[j])
            return
        label = np.arange(len(rows))
        while True:
            of_column = np.where(near, label[:, None], len(rows)).min(axis=0)
            of_row = np.minimum(label, np.where(near, of_column[None], len(rows)).min(axis=1))
            if (of_row == label).all():
                break
            label = of_row
        self._edge(rows, columns[near.argmax(axis=1)], near.any(axis=1))
        # A row and a column of one component share its label: the row of that number stands for both.
        self._edge(rows[np.minimum(of_column, len(rows) - 1)], columns, of_column < len(rows))
        self._edge_rows(rows, rows[label])

    def _edge(self, i: np.ndarray, j: np.ndarray, where: np.ndarray | slice = slice(None)) -> None:
        self.edges.append(np.stack([i, j + self.shift], axis=1)[where])
        if sum(map(len, self.edges)) > 1_000_000:
            self.edges = [self.forest()]

    def _edge_rows(self, i: np.ndarray, j: np.ndarray) -> None:
        self.edges.append(np.stack([i, j], axis=1))

    def forest(self) -> np.ndarray:
        """(row, least row that it is joined with), for the rows that aren't the least themselves."""
        n = self.shift + len(self.y)
        label = np.arange(n)
        links = np.concatenate([*self.edges, np.zeros((0, 2), np.int64)]).astype(np.int64)
        while len(links):
            a, b = label[links[:, 0]], label[links[:, 1]]
            links = links[a != b]
            if not len(links):
                break
            low, high = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
        at = np.flatnonzero(label != np.arange(n))
        return np.stack([at, label[at]], axis=1)

    def traverse(self, a: Node | None, b: Node | None) -> Links:
        stack = [(a, b)] if a is not None and b is not None else []
        while stack:
            p, q = stack.pop()
            twin = self.same and p is q
            apart = 0.0 if twin else float(angle(float(self.x[p.centre] @ self.y[q.centre])))
            if apart - p.radius - q.radius > self.limit + 2e-3:
                continue
            if apart + p.radius + q.radius < self.limit - 2e-3:
                self.all_near(p, q)
            elif not p.children and not q.children:
                self.compare(p, q)
            elif twin:
                n = len(p.children)
                stack += [(p.children[k], p.children[m]) for k in range(n) for m in range(k, n)]
            elif not q.children or (p.children and p.radius >= q.radius):
                stack += [(c, q) for c in p.children]
            else:
                stack += [(p, c) for c in q.children]
        return self


def reference_net(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points of the sample: a prefix of the order is a net of the cover tree, whatever its length."""
    chosen, far = [0], angle(sample @ sample[0])
    while len(chosen) < min(count, len(sample)):
        k = int(far.argmax())
        chosen.append(k)
        far = np.minimum(far, angle(sample @ sample[k]))
    return sample[chosen]


def classes(
    frame: DataFrame, cosine: float = COSINE, key: str = "vec_id", column: str = "embedding", cell: int = CELL, block: int = BLOCK, most: int = CELLS
) -> DataFrame:
    """(vec_id, class_id, group_id, links) of every usable row.

    ``class_id`` is the least id with an equal vector, ``group_id`` the least that links lead to, ``links`` the number
    of other rows with at least that cosine.
    """
    spark, limit = frame.sparkSession, math.acos(cosine)
    points = common.durable(vectors.clean(frame, key, column))
    known = common.durable(points.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    n = known.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, class_id long, group_id long, links long")
    cells = max(1, min(most, math.ceil(n / cell)))
    sample = common.bounded_sample(known, "rep", max(2048, SAMPLE * cells), SEED).toPandas().sort_values("rep")
    centres = reference_net(vectors.matrix(sample["vec"].to_numpy()).astype(np.float32), cells)

    def place(found):
        for batch in found:
            rows = vectors.matrix(batch["vec"].to_numpy(), centres.shape[1])
            away = angle(rows.astype(np.float32) @ centres.T)
            home = away.argmin(axis=1)
            yield pd.DataFrame(
                {
                    "id": batch["rep"],
                    "vec": [r.astype(np.float64).tobytes() for r in rows],
                    "copies": batch["copies"],
                    "home": home.astype(np.int32),
                    "near": away[np.arange(len(rows)), home].astype(np.float64),
                }
            )

    placed = common.durable(known.mapInPandas(place, "id long, vec binary, copies long, home int, near double"))
    radius, load = np.full(cells, -10.0), np.zeros(cells, np.int64)
    for r in placed.groupBy("home").agg(F.max("near").alias("near"), F.count("*").alias("n")).collect():
        radius[r.home], load[r.home] = r.near, r.n

    def visit(found):
        for batch in found:
            rows = np.stack([np.frombuffer(v, np.float64) for v in batch["vec"]]).astype(np.float32) if len(batch) else np.zeros((0, centres.shape[1]))
            home = batch["home"].to_numpy()
            goes = angle(rows @ centres.T) <= radius[None] + limit + 2e-3
            goes &= np.arange(cells)[None] > home[:, None]
            row, to = np.nonzero(goes)
            row, to, own = np.append(np.arange(len(batch)), row), np.append(home, to), np.arange(len(batch) + len(row)) < len(batch)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[row], "vec": batch["vec"].to_numpy()[row], "copies": batch["copies"].to_numpy()[row], "cell": to.astype(np.int32), "own": own})

    schema = "id long, vec binary, copies long, cell int, own boolean"
    sent = placed.mapInPandas(visit, schema)
    guests = np.zeros(cells, np.int64)
    for r in sent.where("not own").groupBy("cell").count().collect():
        guests[r.cell] = r["count"]
    blocks = spark.createDataFrame(
        [(k, max(1, math.ceil(int(load[k]) / block)), math.ceil(int(guests[k]) / block)) for k in range(cells)], "cell int, mine int, theirs int"
    )
    spread = F.xxhash64(F.lit(SEED), "id")
    own = F.pmod(spread, F.col("mine")).cast("int")
    guest = (F.col("mine") + F.pmod(spread, F.greatest("theirs", F.lit(1)))).cast("int")
    # A block meets each block from its own number on, and each of the cell's own blocks before it.
    last = F.when(F.col("own"), F.col("mine") + F.col("theirs") - 1).otherwise(F.col("mine") - 1)
    dealt = (
        sent.join(F.broadcast(blocks), "cell")
        .withColumn("at", F.when(F.col("own"), own).otherwise(guest))
        .select("id", "vec", "copies", "cell", "at", F.explode(F.sequence(F.lit(0), last)).alias("with"))
        .select("id", "vec", "copies", "cell", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), (F.col("at") <= F.col("with")).alias("left"))
    )

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        left, ids, copies = rows["left"].to_numpy(), rows["id"].to_numpy(), rows["copies"].to_numpy()
        exact = np.stack([np.frombuffer(v, np.float64) for v in rows["vec"]])
        if same:
            tree = build(exact.astype(np.float32))
            found, ids = Links(exact, copies, exact, copies, cosine, same=True).traverse(tree, tree), ids
            near = found.near_x + (found.near_y if len(ids) else 0)
        else:
            x, y = exact[left], exact[~left]
            found = Links(x, copies[left], y, copies[~left], cosine).traverse(build(x.astype(np.float32)), build(y.astype(np.float32)))
            ids = np.concatenate([ids[left], ids[~left]])
            near = np.concatenate([found.near_x, found.near_y])
        forest, some = found.forest(), near > 0
        return pd.DataFrame(
            {
                "a": np.concatenate([ids[some], ids[forest[:, 0]]]),
                "b": pd.array([None] * int(some.sum()) + ids[forest[:, 1]].tolist(), "Int64"),
                "n": np.concatenate([np.rint(near[some]).astype(np.int64), np.zeros(len(forest), np.int64)]),
            }
        )

    met = common.durable(dealt.groupBy("cell", "i", "j").applyInPandas(join, "a long, b long, n long"))
    links = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = common.components(met.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    linked = known.join(links, "rep", "left").join(roots, "rep", "left").select(
        "vec", "rep", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links")
    )
    return points.join(linked, "vec").select(F.col("id").alias("vec_id"), F.col("rep").alias("class_id"), F.col("root").alias("group_id"), "links")


def oracle_sql(cosine: float = COSINE) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= {cosine}),
reach(id, root) AS (
  SELECT id, id FROM v
  UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id)
SELECT v.id AS vec_id, min(v.id) OVER (PARTITION BY v.e) AS class_id,
       (SELECT min(r.root) FROM reach r WHERE r.id = v.id) AS group_id,
       (SELECT count(*) FROM pairs p WHERE p.a = v.id) AS links
FROM v
"""
