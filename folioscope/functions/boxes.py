"""Batches of upright rectangles of whole coordinates, for which the overlays of ``polygon`` have closed or small forms.

``polygon`` stands for all other outlines; both give the same rings.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import flat, polygon


def of_rings(rings: flat.Rings) -> tuple[np.ndarray, np.ndarray]:
    """Which rings are rectangles from the upper left corner clockwise, and corners (x0, y0, x1, y1) of all, 0 for others."""
    box = np.zeros((len(rings.sizes), 4), np.int64)
    four = np.flatnonzero(rings.sizes == 4)
    at = rings.starts[four][:, None] + np.arange(4)[None]
    x, y = rings.x[at], rings.y[at]
    good = (x[:, 0] == x[:, 3]) & (x[:, 1] == x[:, 2]) & (y[:, 0] == y[:, 1]) & (y[:, 2] == y[:, 3]) & (x[:, 0] < x[:, 1]) & (y[:, 0] < y[:, 2])
    good &= ((x == np.rint(x)) & (y == np.rint(y)) & (np.abs(x) < flat.EXACT) & (np.abs(y) < flat.EXACT)).all(axis=1)
    four, x, y = four[good], x[good], y[good]
    box[four] = np.stack([x[:, 0], y[:, 0], x[:, 1], y[:, 2]], axis=1).astype(np.int64)
    is_box = np.zeros(len(rings.sizes), bool)
    is_box[four] = True
    return is_box, box


def text(xs: list[np.ndarray], ys: list[np.ndarray]) -> pa.Array:
    """Coordinate texts of rings that have their k-th points in xs[k], ys[k]."""
    number = lambda v: pc.cast(pa.array(v, pa.int64()), pa.string())
    points = [pc.binary_join_element_wise(number(x), number(y), ",") for x, y in zip(xs, ys, strict=True)]
    return pc.binary_join_element_wise(*points, " ")


def box_text(box: np.ndarray) -> pa.Array:
    x0, y0, x1, y1 = box.T
    return text([x0, x1, x1, x0], [y0, y0, y1, y1])


def area(box: np.ndarray) -> np.ndarray:
    return ((box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])).astype(float)


def ring(box) -> polygon.Ring:
    x0, y0, x1, y1 = map(float, box)
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def outlines(xs: list, ys: list, rows: list[int]) -> list[polygon.Ring]:
    """``polygon.Grid.outlines`` of a small grid, whose rows are bits."""
    high, high_bit = len(rows), len(rows) + 1
    # Steps right, down, left and up on points numbered x * high_bit + y.
    steps = (high_bit, 1, -high_bit, -1)
    after: dict[int, list[int]] = {}
    above = 0
    for y, row in enumerate(rows):
        below = rows[y + 1] if y + 1 < high else 0
        if row:
            edges = ((row & ~above, 0, 0, 0), (row & ~(row >> 1), 1, 0, 1), (row & ~below, 1, 1, 2), (row & ~(row << 1), 0, 1, 3))
            for bits, dx, dy, way in edges:
                while bits:
                    low = bits & -bits
                    after.setdefault((low.bit_length() - 1 + dx) * high_bit + y + dy, []).append(way)
                    bits ^= low
        above = row
    found = []
    while after:
        first = at = min(after)
        before, points = -1, []
        while True:
            ways = after[at]
            way = ways[0] if len(ways) == 1 or ways[0] == (before + 1) % 4 else ways[1]
            ways.remove(way)
            if not ways:
                del after[at]
            if way != before:
                points.append(at)
            before = way
            at += steps[way]
            if at == first:
                break
        real = [(float(xs[p // high_bit]), float(ys[p % high_bit])) for p in points]
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(real, real[1:] + real[:1], strict=True)) > 0:
            found.append(real)
    return sorted(found, key=lambda r: (-polygon.area(r), r))


def _bits(xs: list, x0, x1) -> int:
    """The columns from x0 to x1, both of them bounds."""
    return (1 << xs.index(x1)) - (1 << xs.index(x0))


def union(boxes: list) -> list[polygon.Ring]:
    """Outer rings of the parts of a union, the largest first."""
    xs, ys = sorted({x for b in boxes for x in (b[0], b[2])}), sorted({y for b in boxes for y in (b[1], b[3])})
    rows = [0] * (len(ys) - 1)
    for x0, y0, x1, y1 in boxes:
        bits = _bits(xs, x0, x1)
        for k in range(ys.index(y0), ys.index(y1)):
            rows[k] |= bits
    return outlines(xs, ys, rows)


def join(boxes: list, scale: float = 20) -> polygon.Ring:
    """``polygon.join`` of rectangles; strips between parts that face each other are rectangles, too."""
    parts = union(boxes)
    if len(parts) == 1:
        return parts[0]
    width, strips = max(1.0, scale / 5), []
    for _, _, _, p, q in polygon.bridges(parts):
        if p == q or p[0] != q[0] and p[1] != q[1]:
            return polygon.join([ring(b) for b in boxes], scale)
        strips.append((min(p[0], q[0]) - width, min(p[1], q[1]) - width, max(p[0], q[0]) + width, max(p[1], q[1]) + width))
    return union([*boxes, *strips])[0]


def cuts(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Bounds of a rectangle and of what another one cuts out of it (x, y: four each), and as bits the sides left of it.

    Rectangles that don't overlap leave all but an empty strip at a side.
    """
    low, high = np.maximum(a[:, :2], b[:, :2]), np.minimum(a[:, 2:], b[:, 2:])
    none = (low >= high).any(axis=1)
    low[none], high[none] = a[none, :2], np.stack([a[none, 0], a[none, 3]], axis=1)
    sides = sum((when.astype(int) << k) for k, when in enumerate((low[:, 0] > a[:, 0], low[:, 1] > a[:, 1], high[:, 0] < a[:, 2], high[:, 1] < a[:, 3])))
    return tuple(np.stack([a[:, c], low[:, c], high[:, c], a[:, 2 + c]]) for c in range(2)), sides


def grown(box, by: int, others: list) -> polygon.Ring:
    """A rectangle grown by a distance where none of the others, which meet the grown one, is: the largest part."""
    x0, y0, x1, y1 = box
    left, top, right, bottom = x0 - by, y0 - by, x1 + by, y1 + by
    cut = [(max(a, left), max(b, top), min(c, right), min(d, bottom)) for a, b, c, d in others]
    xs, ys = sorted({left, x0, x1, right, *(x for b in cut for x in (b[0], b[2]))}), sorted({top, y0, y1, bottom, *(y for b in cut for y in (b[1], b[3]))})
    rows = [(1 << len(xs) - 1) - 1] * (len(ys) - 1)
    for a, b, c, d in cut:
        bits = ~_bits(xs, a, c)
        for k in range(ys.index(b), ys.index(d)):
            rows[k] &= bits
    own = _bits(xs, x0, x1)
    for k in range(ys.index(y0), ys.index(y1)):
        rows[k] |= own
    return outlines(xs, ys, rows)[0]


def meeting(box: np.ndarray, starts: np.ndarray, sizes: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a group whose rectangle i, grown by a distance, overlaps j; by i, then j."""
    first, second = [], []
    for n in np.unique(sizes[sizes > 1]).tolist():
        of = starts[sizes == n]
        step = max(1, flat.PAIRS // (n * n))
        # Very large groups are taken in stripes of rows, so that memory is bounded.
        rows = max(1, min(n, flat.PAIRS // n))
        for k in range(0, len(of), step):
            at = of[k : k + step][:, None] + np.arange(n)[None]
            x0, y0, x1, y1 = (box[at, c] for c in range(4))
            for r in range(0, n, rows):
                own = slice(r, r + rows)
                met = (x0[:, own, None] - by < x1[:, None]) & (x0[:, None] < x1[:, own, None] + by) & (y0[:, own, None] - by < y1[:, None]) & (y0[:, None] < y1[:, own, None] + by)
                g, i, j = np.nonzero(met)
                i += r
                other = i != j
                first.append(at[g[other], i[other]])
                second.append(at[g[other], j[other]])
    if not first:
        return np.zeros(0, int), np.zeros(0, int)
    first, second = np.concatenate(first), np.concatenate(second)
    order = np.lexsort((second, first))
    return first[order], second[order]


def trees(box: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, distance) of each group's minimum spanning tree (Prim), groups of one size together."""
    parts = []
    for n in np.unique(sizes[sizes > 1]).tolist():
        of = starts[sizes == n]
        for k in range(0, len(of), max(1, flat.PAIRS // n)):
            at = of[k : k + max(1, flat.PAIRS // n)][:, None] + np.arange(n)[None]
            corners, g = [box[at, c].astype(float) for c in range(4)], np.arange(len(at))

            def away(k: np.ndarray) -> np.ndarray:
                x0, y0, x1, y1 = (c[g, k][:, None] for c in corners)
                return np.hypot(np.maximum(0, np.maximum(corners[0] - x1, x0 - corners[2])), np.maximum(0, np.maximum(corners[1] - y1, y0 - corners[3])))

            near, via = away(np.zeros(len(at), int)), np.zeros(at.shape, int)
            left = np.ones(at.shape, bool)
            left[:, 0] = False
            edges = []
            for _ in range(n - 1):
                new = np.where(left, near, np.inf).argmin(axis=1)
                edges.append((at[g, via[g, new]], at[g, new], near[g, new]))
                left[g, new] = False
                other = away(new)
                closer = left & (other < near)
                near, via = np.where(closer, other, near), np.where(closer, new[:, None], via)
            parts.append([np.stack(e, axis=1).ravel() for e in zip(*edges, strict=True)])
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(e) for e in zip(*parts, strict=True))


def hulls(box: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The joint box of each group."""
    return np.stack([(np.minimum if c < 2 else np.maximum).reduceat(box[:, c], starts) for c in range(4)], axis=1)


def stacked(box: np.ndarray, sizes: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Whether a group's rectangles fill its joint box as strips of its whole width or height, without gaps."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(sizes), bool)
    for low, high in ((1, 3), (0, 2)):
        across = (box[:, 1 - low] == joint[of, 1 - low]) & (box[:, 5 - high] == joint[of, 5 - high])
        order = np.lexsort((box[:, low], of))
        a, b, shift = box[order, low], box[order, high], of * np.int64(4 * flat.EXACT)
        reached = np.maximum.accumulate(b + shift) - shift
        gap = np.zeros(len(of), bool)
        gap[1:] = (a[1:] > reached[:-1]) & (of[1:] == of[:-1])
        out |= np.bincount(of, gap | ~across, len(sizes)) == 0
    return out


@lru_cache(maxsize=16)
def cut(left: bool, top: bool, right: bool, bottom: bool) -> tuple:
    """Rings of a rectangle without the middle of it, as places among four bounds; which sides are left of it."""
    low, high = (lambda side: 1.0 if side else 0.0), (lambda side: 2.0 if side else 3.0)
    parts = polygon.difference(ring((0, 0, 3, 3)), ring((low(left), low(top), high(right), high(bottom))))
    return tuple(tuple((int(x), int(y)) for x, y in part) for part in parts)
