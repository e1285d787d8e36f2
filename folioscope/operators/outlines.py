"""Operators on general outlines, in batches of rows or, where siblings matter, of whole parents.

Kernels run on Arrow batches: an overlay has no counterpart among column functions. Rows come grouped by page only
where an outline depends on its siblings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import boxes, flat, polygon
from . import groups


def ring_of(text: str) -> polygon.Ring:
    return [tuple(map(float, p.split(","))) for p in text.split()] if text else []


def text_of(points: polygon.Ring) -> str:
    """Whole numbers, halves to even."""
    return " ".join(f"{round(x)},{round(y)}" for x, y in points)


def _pairwise(pairs: DataFrame, keys: str, sides: tuple[str, str], kernel: Callable, single: Callable, result: str) -> DataFrame:
    """``result`` by row, from two outlines (sides): kernel(a, b) of the corners where both are rectangles, else single(a, b)."""
    names = [f.split()[0] for f in result.split(", ")]
    types = {f.split()[0]: {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}[f.split()[1]] for f in result.split(", ")}

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            a, b = (flat.of_texts(batch.column(side)) for side in sides)
            (a_is, a_box), (b_is, b_box) = boxes.of_rings(a), boxes.of_rings(b)
            plain = a_is & b_is
            columns = kernel(a_box[plain], b_box[plain])
            other = np.flatnonzero(~plain).tolist()
            if other:
                rows = [single(a.ring(k), b.ring(k)) for k in other]
                back = pa.array(np.argsort(np.concatenate([np.flatnonzero(plain), other]), kind="stable"))
                columns = [pa.concat_arrays([pa.array(c, types[n]), pa.array(v, types[n])]).take(back) for n, c, v in zip(names, columns, zip(*rows, strict=True), strict=True)]
            made = [pa.array(c, types[n]) if not isinstance(c, pa.Array) else c for n, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys.split()] + made, [*keys.split(), *names])

    return pairs.select(*keys.split(), *sides).mapInArrow(batches, f"{groups.kinds(pairs, *keys.split())}, {result}")


def merge_outline(pairs: DataFrame) -> DataFrame:
    """(page_id, a_seg_id, b_seg_id, points, area) of the joint outline of each pair (a_points, b_points)."""

    def single(a, b) -> tuple:
        out = polygon.join([a, b])
        return text_of(out), polygon.area(out)

    def kernel(a, b) -> list:
        rings = [boxes.join(list(pair)) for pair in zip(a.tolist(), b.tolist(), strict=True)]
        return [list(map(text_of, rings)), list(map(polygon.area, rings))]

    return _pairwise(pairs, "page_id a_seg_id b_seg_id", ("a_points", "b_points"), kernel, single, "points string, area double")


def apply_splits(pairs: DataFrame) -> DataFrame:
    """(page_id, line_id, other_id, points, area, parts): a line's outline (points) cut by another's (other_points).

    Several parts are bridged to one outline; ``area`` is that of the parts. Nothing left gives null points.
    """

    def single(a, b) -> tuple:
        parts = polygon.difference(a, b)
        out = polygon.join(parts) if len(parts) > 1 else parts[0] if parts else None
        return text_of(out) if out else None, sum(map(polygon.area, parts)), len(parts)

    def kernel(a, b) -> list:
        bounds, sides = boxes.cuts(a, b)
        points, area, parts = np.full(len(a), None, object), np.zeros(len(a)), np.zeros(len(a), int)
        for way in np.unique(sides).tolist():
            at = np.flatnonzero(sides == way)
            rings = boxes.cut(*(bool(way & 1 << k) for k in range(4)))
            xs, ys = bounds[0][:, at], bounds[1][:, at]
            parts[at] = len(rings)
            for r in rings:
                x, y = [xs[i] for i, _ in r], [ys[j] for _, j in r]
                area[at] += np.abs(sum(x[k - 1] * y[k] - x[k] * y[k - 1] for k in range(len(r)))) / 2
            if len(rings) == 1:
                points[at] = boxes.text([xs[i] for i, _ in rings[0]], [ys[j] for _, j in rings[0]]).to_numpy(zero_copy_only=False)
            elif rings:
                for k, u, v in zip(at.tolist(), xs.T.tolist(), ys.T.tolist(), strict=True):
                    points[k] = text_of(boxes.join([(u[r[0][0]], v[r[0][1]], u[r[2][0]], v[r[2][1]]) for r in rings]))
        return [points, area, parts]

    made = _pairwise(pairs, "page_id line_id other_id", ("points", "other_points"), kernel, single, "cut string, area double, parts long")
    return made.withColumnRenamed("cut", "points")


def make_valid(rows: DataFrame) -> DataFrame:
    """(page_id, seg_id, points, changed): outlines repaired where they cross themselves or have no area.

    Which outlines are simple is found for a batch at once; only the others are taken one by one.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = pc.fill_null(batch.column("points"), "")
            rings = flat.of_texts(texts)
            given, changed = rings.sizes > 0, np.zeros(len(rings.sizes), bool)
            kept = pc.match_substring_regex(texts, flat.WRITTEN).to_numpy(zero_copy_only=False)
            simple = flat.simple(rings)
            points = texts.to_pylist() if not (kept & (simple | ~given)).all() else texts
            for k in np.flatnonzero(given & ~(kept & simple)).tolist():
                ring = rings.ring(k)
                out = ring if simple[k] else polygon.make_valid(ring)
                points[k], changed[k] = text_of(out), out != ring
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("seg_id"), pa.array(points, pa.string()), pa.array(changed)], ["page_id", "seg_id", "points", "changed"])

    named = rows.select("page_id", "seg_id", "points")
    return named.mapInArrow(batches, f"{groups.kinds(rows, 'page_id', 'seg_id')}, points string, changed boolean")


def _by_parent(rows: DataFrame, keys: list[str], kernel: Callable, single: Callable, result: str) -> DataFrame:
    """Rows (.., seg_id, points) by parent, in the order of ids, in batches of whole parents.

    kernel(ids, box, starts, sizes) takes the parents whose outlines are all rectangles, and gives the place of its
    parent for each row of the result, and the result's columns; single(ids, rings) takes each of the others and gives
    tuples. ``starts`` and ``sizes`` are of parents, ``box`` has the rows' corners.
    """
    names = [f.split()[0] for f in result.split(", ")]
    kinds = {f.split()[0]: {"string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in result.split(", ")}

    def made(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        ids = groups.chunk(table, "seg_id")
        rings = flat.of_texts(groups.chunk(table, "points"))
        sizes = np.diff(np.append(starts, table.num_rows))
        is_box, box = boxes.of_rings(rings)
        plain = np.logical_and.reduceat(is_box, starts)
        rows, values = kernel(ids, box, starts[plain], sizes[plain])
        of, columns = [np.flatnonzero(plain)[rows]], [[pa.array(v, kinds[n]) if not isinstance(v, pa.Array) else v] for n, v in zip(names, values, strict=True)]
        for k in np.flatnonzero(~plain).tolist():
            at = range(int(starts[k]), int(starts[k] + sizes[k]))
            found = single([ids[i].as_py() for i in at], [rings.ring(i) for i in at])
            of.append(np.full(len(found), k))
            for column, n, v in zip(columns, names, zip(*found, strict=True) if found else [()] * len(names), strict=True):
                column.append(pa.array(v, kinds[n]))
        head = table.select(keys).take(pa.array(starts[np.concatenate(of)]))
        for n, column in zip(names, columns, strict=True):
            head = head.append_column(n, pa.chunked_array(column, kinds[n]))
        yield head.combine_chunks()

    filled = rows.where(F.length("points") > 0).select(*keys, "seg_id", "points")
    return groups.whole(filled, keys, ["seg_id", "points"], made, f"{groups.kinds(rows, *keys)}, {result}")


def project_hull(children: DataFrame, scale: float = 20) -> DataFrame:
    """(page_id, parent_id, points, area): the joint outline of each parent's children."""

    def single(_, rings) -> list[tuple]:
        out = polygon.join(rings, scale)
        return [(text_of(out), polygon.area(out))]

    def kernel(_, box, starts, sizes):
        if not len(starts):
            return np.zeros(0, int), [[], []]
        begin = np.cumsum(sizes) - sizes
        own = box[np.repeat(starts - begin, sizes) + np.arange(int(sizes.sum()))]
        joint = boxes.hulls(own, begin)
        points, area = boxes.box_text(joint), boxes.area(joint)
        other = np.flatnonzero(~boxes.stacked(own, sizes, joint)).tolist()
        if other:
            points = points.to_pylist()
            for k in other:
                out = boxes.join(box[starts[k] : starts[k] + sizes[k]].tolist(), scale)
                points[k], area[k] = text_of(out), polygon.area(out)
        return np.arange(len(starts)), [points, area]

    return _by_parent(children, ["page_id", "parent_id"], kernel, single, "points string, area double")


def convex_hull(children: DataFrame) -> DataFrame:
    """(page_id, parent_id, points, area): the convex hull of each parent's children."""

    def single(_, rings) -> list[tuple]:
        out = polygon.hull([p for r in rings for p in r])
        return [(text_of(out), polygon.area(out))]

    def kernel(_, box, starts, sizes):
        if not len(starts):
            return np.zeros(0, int), [[], []]
        of, begin = np.repeat(np.arange(len(starts)), sizes), np.cumsum(sizes) - sizes
        own = box[np.repeat(starts - begin, sizes) + np.arange(len(of))]
        joint = boxes.hulls(own, begin)
        points, area = boxes.box_text(joint), boxes.area(joint)
        at = own == joint[of]
        # The hull is the joint box where each of its corners is one of a child.
        corner = np.logical_and.reduce([np.logical_or.reduceat(at[:, x] & at[:, y], begin) for x in (0, 2) for y in (1, 3)])
        other = np.flatnonzero(~corner).tolist()
        if other:
            points = points.to_pylist()
            for k in other:
                points[k], area[k] = single(None, [boxes.ring(b) for b in box[starts[k] : starts[k] + sizes[k]].tolist()])[0]
        return np.arange(len(starts)), [points, area]

    return _by_parent(children, ["page_id", "parent_id"], kernel, single, "points string, area double")


def mst_bridges(segments: DataFrame) -> DataFrame:
    """(page_id, a, b, distance): the spanning tree of nearest points over each page's outlines."""

    def single(ids, rings) -> list[tuple]:
        return [(ids[i], ids[j], round(d, 3)) for i, j, d, _, _ in polygon.bridges(rings)]

    def kernel(ids, box, starts, sizes):
        a, b, away = boxes.trees(box, starts, sizes)
        return np.searchsorted(starts, a, "right") - 1, [ids.take(pa.array(a)), ids.take(pa.array(b)), [round(d, 3) for d in away.tolist()]]

    return _by_parent(segments, ["page_id"], kernel, single, "a string, b string, distance double")


def spread(segments: DataFrame, by: int) -> DataFrame:
    """(page_id, seg_id, points, area): outlines grown by a distance into the space that no sibling holds."""

    def single(ids, rings) -> list[tuple]:
        return [(k, text_of(r), polygon.area(r)) for k, r in zip(ids, polygon.spread(rings, by), strict=True)]

    def kernel(ids, box, starts, sizes):
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(starts - begin, sizes) + np.arange(int(sizes.sum()))
        place = np.zeros(len(box), int)
        place[at] = np.arange(len(at))
        wide = box[at] + np.array([-by, -by, by, by])
        points, area = boxes.box_text(wide).to_pylist(), boxes.area(wide)
        first, second = boxes.meeting(box, starts, sizes, by)
        begin = np.flatnonzero(np.diff(first, prepend=-1))
        corners, others = box.tolist(), second.tolist()
        for i, a, b in zip(first[begin].tolist(), begin.tolist(), np.append(begin, len(first))[1:].tolist(), strict=True):
            out = boxes.grown(corners[i], by, [corners[j] for j in others[a:b]])
            points[place[i]], area[place[i]] = text_of(out), polygon.area(out)
        return np.repeat(np.arange(len(starts)), sizes), [ids.take(pa.array(at)), points, area]

    return _by_parent(segments, ["page_id"], kernel, single, "seg_id string, points string, area double")


def resample(rows: DataFrame, step: float, every: bool = True) -> DataFrame:
    """rows with their rings (ring) as points at equal distances along them from the first one.

    Unless ``every`` ring is asked for, those that ``simplifies`` leaves alone go, in the same pass.
    """
    names = rows.columns

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not every:
                given = flat.of_points(batch.column(names.index("ring")))
                batch = batch.filter(pa.array(_simplifies(given, step)))
            given = batch.column(names.index("ring"))
            made = flat.to_points(flat.resample(flat.of_points(given), step))
            made = pc.if_else(given.is_valid(), made, pa.scalar(None, made.type)) if given.null_count else made
            yield pa.RecordBatch.from_arrays([made if n == "ring" else batch.column(k) for k, n in enumerate(names)], names)

    return rows.mapInArrow(batches, groups.kinds(rows, *names))


def _simplifies(given: flat.Rings, tolerance: float) -> np.ndarray:
    area, edge = flat.measures(given)
    n = given.sizes
    return (tolerance > 0) & (n >= 10) & (edge >= 4 * tolerance) & (edge <= tolerance * n) & (np.sqrt(area) >= 0.1 * tolerance)


def simplifies(outline: Column, tolerance: float) -> Column:
    """Whether an outline is resampled: not if it has few points, is short, small, or has no more points than that."""

    def judged(rings: pa.Array) -> pa.Array:
        return pa.array(_simplifies(flat.of_points(rings), tolerance), mask=rings.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(judged, "boolean")(outline)


def sums(outline: Column) -> Column:
    """The sums of an outline's coordinates (x, y), in the order of its points."""

    def summed(rings: pa.Array) -> pa.Array:
        given = flat.of_points(rings)
        of = np.repeat(np.arange(len(given.sizes)), given.sizes)
        x, y = (np.bincount(of, v, len(given.sizes)) for v in (given.x, given.y))
        return pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    return F.arrow_udf(summed, "x double, y double")(outline)
