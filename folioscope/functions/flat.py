"""Rings of a whole batch as flat arrays of points, and tests and measures of all of them at once.

A ring's points follow each other; ``sizes`` has the number of points of each ring. Steps that are exact in whole
numbers are taken for rings of whole coordinates below ``EXACT``, single rings go to the kernels of ``polygon``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import polygon

#: Products of differences of coordinates below this are exact.
EXACT = 2.0**25
#: Pairs of edges compared at once.
PAIRS = 1 << 20
_NUMBER = "(0|-?[1-9][0-9]{0,14})"
#: Coordinate text that is written again as it was read.
WRITTEN = f"^({_NUMBER},{_NUMBER}( {_NUMBER},{_NUMBER})*)?$"


class Rings(NamedTuple):
    x: np.ndarray
    y: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def ring(self, k: int) -> polygon.Ring:
        at = slice(int(self.starts[k]), int(self.starts[k] + self.sizes[k]))
        return list(zip(self.x[at].tolist(), self.y[at].tolist(), strict=True))


def of_texts(texts: pa.Array) -> Rings:
    """Rings of coordinate texts; null and empty ones have no points."""
    texts = pc.fill_null(texts, "")
    sizes = pc.count_substring(texts, ",").to_numpy().astype(np.int64)
    spaced = pc.binary_join_element_wise(texts, pa.scalar("", texts.type), pa.scalar(" ", texts.type))
    offsets, data = spaced.buffers()[1:]
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(spaced.type) else np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
    numbers = np.fromstring(memoryview(data)[at[0] : at[-1]].tobytes().replace(b",", b" "), sep=" ") if sizes.any() else np.zeros(0)
    if len(numbers) != 2 * sizes.sum():
        raise ValueError("coordinates must be pairs of numbers")
    return Rings(numbers[::2], numbers[1::2], sizes)


def of_points(rings: pa.Array) -> Rings:
    """Rings of lists of points (x, y); a null ring has no points, points without a coordinate are left out."""
    sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy().astype(np.int64)
    points = rings.flatten()
    known = pc.and_(pc.is_valid(pc.struct_field(points, "x")), pc.is_valid(pc.struct_field(points, "y"))).to_numpy(zero_copy_only=False)
    x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False) for c in "xy")
    if not known.all():
        of = np.repeat(np.arange(len(sizes)), sizes)[known]
        x, y, sizes = x[known], y[known], np.bincount(of, minlength=len(sizes))
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("coordinates must be finite")
    return Rings(x, y, sizes)


def to_points(rings: Rings) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(rings.x), pa.array(rings.y)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rings.sizes)]).astype(np.int32)), points)


def _after(sizes: np.ndarray) -> np.ndarray:
    """For each point the place of the next one of its ring."""
    after = np.arange(1, int(sizes.sum()) + 1)
    ends = np.cumsum(sizes)[sizes > 0]
    after[ends - 1] = ends - sizes[sizes > 0]
    return after


def _count(of: np.ndarray, when: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of[when], minlength=n)


def _convex(rings: Rings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By ring: whether it is exact, convex apart from points that repeat the one before, and free of such points.

    All turns go one way, none goes back, and the edges' directions come round once.
    """
    x, y, sizes = rings
    n = len(sizes)
    of, after = np.repeat(np.arange(n), sizes), _after(sizes)
    exact = _count(of, (x != np.rint(x)) | (y != np.rint(y)) | (np.maximum(np.abs(x), np.abs(y)) >= EXACT), n) == 0
    dx, dy = x[after] - x, y[after] - y
    moved = (dx != 0) | (dy != 0)
    of, dx, dy = of[moved], dx[moved], dy[moved]
    left = np.bincount(of, minlength=n)
    after = _after(left)
    turn = dx * dy[after] - dy * dx[after]
    back = (turn == 0) & (dx * dx[after] + dy * dy[after] < 0)
    up = (dy > 0) | ((dy == 0) & (dx > 0))
    right_turns, left_turns = _count(of, turn > 0, n), _count(of, turn < 0, n)
    round_once = (_count(of, ~up & up[after], n) == 1) & (_count(of, back, n) == 0)
    return exact, exact & ((right_turns == 0) != (left_turns == 0)) & round_once, left == sizes


def _pairwise(rings: Rings, which: np.ndarray, test) -> np.ndarray:
    """test(points of (rings, n, 2)) for the rings ``which``, those of one size together."""
    out = np.zeros(len(which), bool)
    sizes, starts = rings.sizes[which], rings.starts[which]
    for n in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == n)
        step = max(1, PAIRS // (n * n))
        for k in range(0, len(of), step):
            part = of[k : k + step]
            at = starts[part][:, None] + np.arange(n)[None]
            out[part] = test(np.stack([rings.x[at], rings.y[at]], axis=2))
    return out


def _turns(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = np.roll(p, -1, axis=1)
    a, d = p[:, :, None], (q - p)[:, :, None]
    side = lambda c: np.sign(d[..., 0] * (c[..., 1] - a[..., 1]) - d[..., 1] * (c[..., 0] - a[..., 0]))
    return side(p[:, None]), side(q[:, None])


def _cross(p: np.ndarray) -> np.ndarray:
    start, end = _turns(p)
    apart = start * end < 0
    return (apart & apart.transpose(0, 2, 1)).any(axis=(1, 2))


def _touch(p: np.ndarray) -> np.ndarray:
    """Whether edges cross or a point lies on an edge that it doesn't belong to."""
    n, q = p.shape[1], np.roll(p, -1, axis=1)
    start, end = _turns(p)
    apart = start * end < 0
    low, high = np.minimum(p, q)[:, :, None], np.maximum(p, q)[:, :, None]
    on = (start == 0) & ((p[:, None] >= low) & (p[:, None] <= high)).all(axis=3)
    k = np.arange(n)
    on[:, k, k] = on[:, k, (k + 1) % n] = False
    return (apart & apart.transpose(0, 2, 1)).any(axis=(1, 2)) | on.any(axis=(1, 2))


def _twice_area(rings: Rings) -> np.ndarray:
    after = _after(rings.sizes)
    return np.bincount(np.repeat(np.arange(len(rings.sizes)), rings.sizes), rings.x * rings.y[after] - rings.x[after] * rings.y, len(rings.sizes))


def simple(rings: Rings) -> np.ndarray:
    """``polygon.is_simple`` of each ring."""
    exact, convex, distinct = _convex(rings)
    out = convex & distinct
    asked = np.flatnonzero(~out & exact & distinct & (rings.sizes > 2) & (_twice_area(rings) != 0))
    out[asked] = ~_pairwise(rings, asked, _touch)
    for k in np.flatnonzero(~exact):
        out[k] = polygon.is_simple(rings.ring(k))
    return out


def problems(rings: Rings) -> list[str | None]:
    """``polygon.problem`` of each ring."""
    n, of = len(rings.sizes), np.repeat(np.arange(len(rings.sizes)), rings.sizes)
    exact, convex, _ = _convex(rings)
    out = np.full(n, None, object)
    after = _after(rings.sizes)
    length = np.bincount(of, np.hypot(rings.x[after] - rings.x, rings.y[after] - rings.y), n)
    out[length < 4] = "too few points"
    out[_count(of, (rings.x < 0) | (rings.y < 0), n) > 0] = "negative"
    out[_twice_area(rings) == 0] = "empty"
    asked = np.flatnonzero(exact & ~convex & (rings.sizes > 2))
    out[asked[_pairwise(rings, asked, _cross)]] = "self-intersection"
    out[rings.sizes < 3] = "too few points"
    for k in np.flatnonzero(~exact & (rings.sizes > 2)):
        out[k] = polygon.problem(np.array(rings.ring(k)))
    return out.tolist()


def measures(rings: Rings) -> tuple[np.ndarray, np.ndarray]:
    """Area and perimeter of each ring, summed in the order of its edges."""
    of, after = np.repeat(np.arange(len(rings.sizes)), rings.sizes), _after(rings.sizes)
    dx, dy = rings.x[after] - rings.x, rings.y[after] - rings.y
    return np.abs(_twice_area(rings)) / 2, np.bincount(of, np.sqrt(dx * dx + dy * dy), len(rings.sizes))


def _lengths(rings: Rings, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the edges of rings of n points, and what is walked up to each edge and in all."""
    at = rings.starts[which][:, None] + np.arange(n)[None]
    x, y = rings.x[at], rings.y[at]
    size = np.hypot(np.roll(x, -1, axis=1) - x, np.roll(y, -1, axis=1) - y)
    return size, np.concatenate([np.zeros((len(which), 1)), np.cumsum(size, axis=1)], axis=1)


def resample(rings: Rings, step: float) -> Rings:
    """Points at equal distances along each ring from its first one; distances stop short of the whole length."""
    made, starts = [], rings.starts
    for n in np.unique(rings.sizes[rings.sizes > 0]).tolist():
        which = np.flatnonzero(rings.sizes == n)
        which = which[np.argsort(_lengths(rings, which, n)[1][:, -1], kind="stable")]
        k = len(which)
        while k:
            # From the longest down, so that a batch has room for as many points of each ring as its longest has.
            longest = _lengths(rings, which[k - 1 : k], n)[1][0, -1]
            part = which[max(0, k - max(1, int(PAIRS // (n + longest / step)))) : k]
            k -= len(part)
            at = starts[part][:, None] + np.arange(n)[None]
            x, y = rings.x[at], rings.y[at]
            dx, dy = np.roll(x, -1, axis=1) - x, np.roll(y, -1, axis=1) - y
            size, begun = _lengths(rings, part, n)
            counts = np.maximum(np.ceil(begun[:, -1] / step - 1e-9).astype(np.int64) - 1, 0) + 1
            row = np.repeat(np.arange(len(part)), counts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            s = np.arange(counts.max()) * float(step)
            # How many edges begin at or before each distance.
            met = np.searchsorted(s, begun) + np.arange(len(part))[:, None] * (len(s) + 1)
            upto = np.bincount(met.ravel(), minlength=len(part) * (len(s) + 1)).reshape(len(part), -1).cumsum(axis=1)[row, number]
            edge = np.minimum(upto, n) - 1
            t = (s[number] - begun[row, edge]) / np.maximum(size[row, edge], 1e-12)
            made.append((part, counts, x[row, edge] + dx[row, edge] * t, y[row, edge] + dy[row, edge] * t))
    sizes = np.zeros(len(rings.sizes), np.int64)
    for part, counts, *_ in made:
        sizes[part] = counts
    starts = np.cumsum(sizes) - sizes
    out = Rings(np.zeros(int(sizes.sum())), np.zeros(int(sizes.sum())), sizes)
    for part, counts, x, y in made:
        at = np.repeat(starts[part] - (np.cumsum(counts) - counts), counts) + np.arange(len(x))
        out.x[at], out.y[at] = x, y
    return out
