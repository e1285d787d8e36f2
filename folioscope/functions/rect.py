"""Column expressions on axis-aligned rectangles: corners are ``{prefix}x0 {prefix}y0 {prefix}x1 {prefix}y1``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CORNERS = ("x0", "y0", "x1", "y1")


def corners(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in CORNERS)


def area(prefix: str = "") -> Column:
    x0, y0, x1, y1 = corners(prefix)
    return (x1 - x0) * (y1 - y0)


def overlap(a: str, b: str) -> Column:
    """Whether the interiors meet; in a join condition it is the residual beside the equal keys."""
    ax0, ay0, ax1, ay1 = corners(a)
    bx0, by0, bx1, by1 = corners(b)
    return (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)


def intersection(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = corners(a)
    bx0, by0, bx1, by1 = corners(b)
    width, height = F.least(ax1, bx1) - F.greatest(ax0, bx0), F.least(ay1, by1) - F.greatest(ay0, by0)
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def within(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = corners(a)
    bx0, by0, bx1, by1 = corners(b)
    return (ax0 >= bx0) & (ay0 >= by0) & (ax1 <= bx1) & (ay1 <= by1)


def same(a: str, b: str) -> Column:
    out = F.lit(True)
    for x, y in zip(corners(a), corners(b), strict=True):
        out = out & (x == y)
    return out


def twice_hull(a: str, b: str) -> Column:
    """Twice the area of the convex hull of two rectangles, in whole numbers: their joint box less four corners."""
    ax0, ay0, ax1, ay1 = corners(a)
    bx0, by0, bx1, by1 = corners(b)
    box = (F.greatest(ax1, bx1) - F.least(ax0, bx0)) * (F.greatest(ay1, by1) - F.least(ay0, by0))
    dx0, dy0, dx1, dy1 = ax0 - bx0, ay0 - by0, ax1 - bx1, ay1 - by1
    cut = sum((F.greatest(F.lit(0), x) for x in (-dx0 * dy0, -dx1 * dy1, dx1 * dy0, dx0 * dy1)), F.lit(0))
    return 2 * box - cut


def points(prefix: str = "") -> Column:
    """The ring as coordinate text, clockwise from the upper left corner."""
    x0, y0, x1, y1 = (c.cast("string") for c in corners(prefix))
    comma, blank = F.lit(","), F.lit(" ")
    return F.concat(x0, comma, y0, blank, x1, comma, y0, blank, x1, comma, y1, blank, x0, comma, y1)
