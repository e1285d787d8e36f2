"""Column expressions on open rings, ``array<struct<x:double,y:double>>``, kept in generated code by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse(text: Column) -> Column:
    """Coordinate text "x,y x,y .." as a ring; an empty or null text is a null ring."""

    def point(pair: Column) -> Column:
        xy = F.split(pair, ",")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    return F.when(F.trim(text) != "", F.transform(F.split(F.trim(text), " +"), point))


def serialize(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat(p.x.cast("long").cast("string"), F.lit(","), p.y.cast("long").cast("string"))), " ")


def box(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def _edges(ring: Column, value) -> Column:
    """The sum of value(p, q) over all edges, the closing one included."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, value), F.lit(0.0), lambda a, b: a + b)


def signed_area(ring: Column) -> Column:
    return _edges(ring, lambda p, q: p.x * q.y - q.x * p.y) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _edges(ring, lambda p, q: F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))


def centroid(ring: Column) -> Column:
    six = 6 * signed_area(ring)
    x = _edges(ring, lambda p, q: (p.x + q.x) * (p.x * q.y - q.x * p.y)) / six
    y = _edges(ring, lambda p, q: (p.y + q.y) * (p.x * q.y - q.x * p.y)) / six
    return F.when(six != 0, F.struct(x.alias("x"), y.alias("y")))


def affine(ring: Column, matrix: list[list[float]]) -> Column:
    """The ring under a 3 x 3 transform."""
    (a, b, c), (d, e, f), _ = matrix
    return F.transform(ring, lambda p: F.struct((p.x * a + p.y * b + c).alias("x"), (p.x * d + p.y * e + f).alias("y")))


def ensure_valid(ring: Column) -> Column:
    """Negative coordinates raised to 0; a ring of one or two points gets its way back, one pixel further."""
    zero = F.lit(0.0)
    clamped = F.transform(ring, lambda p: F.struct(F.greatest(p.x, zero).alias("x"), F.greatest(p.y, zero).alias("y")))
    back = F.reverse(F.transform(clamped, lambda p: F.struct((p.x + 1).alias("x"), (p.y + 1).alias("y"))))
    return F.when(F.size(ring) < 3, F.concat(clamped, back)).otherwise(clamped)


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by the parity of the edges to its right."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, after, lambda p, q: ((p.y > y) != (q.y > y)) & (x < (q.x - p.x) * (y - p.y) / (q.y - p.y) + p.x))
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1
