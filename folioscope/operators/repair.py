"""Redundant neighbours, their resolution, validity and consistency with parents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import flat, rect, ring
from . import groups

#: A smaller share of overlap leaves a pair undecided.
SHARE = 0.9


def ranked(segments: DataFrame, group: list[str]) -> DataFrame:
    """Segments with their area and their rank by it among siblings, in a total order."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy("area", "seg_id"))
    return segments.withColumn("area", rect.area()).withColumn("rank", rank)


def overlap_pairs(segments: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Overlapping siblings, the smaller first, with the area of their intersection and twice that of their hull."""
    group = group or ["page_id", "seg_class"]
    order = ranked(segments, group)
    side = lambda p: order.select(*group, *[F.col(c).alias(p + c) for c in ("seg_id", "area", "rank", *rect.CORNERS)])
    met = side("a_").join(side("b_"), group).where((F.col("a_rank") < F.col("b_rank")) & rect.overlap("a_", "b_"))
    return met.withColumn("inter", rect.intersection("a_", "b_")).withColumn("hull2", rect.twice_hull("a_", "b_"))


def classify(pairs: DataFrame, share: float = SHARE) -> DataFrame:
    """What is to be done about each pair, a being the smaller: the rules apply in this order."""
    decision = (
        F.when(rect.same("a_", "b_"), "delete_b_equal")
        .when(rect.within("b_", "a_"), "delete_b_within")
        .when(rect.within("a_", "b_"), "delete_a_within")
        .when(F.col("hull2") >= 2 * (F.col("a_area") + F.col("b_area")), "undecided_hull")
        .when(F.col("inter") > share * F.col("b_area"), "merge_b_into_a")
        .when(F.col("inter") > share * F.col("a_area"), "merge_a_into_b")
        .otherwise("undecided")
    )
    return pairs.withColumn("decision", decision)


def apply_deletes(segments: DataFrame, decided: DataFrame) -> DataFrame:
    """Segments without those that a pair gives up."""
    first = decided.where("decision like 'delete_a%'").select("page_id", F.col("a_seg_id").alias("seg_id"))
    second = decided.where("decision like 'delete_b%'").select("page_id", F.col("b_seg_id").alias("seg_id"))
    return segments.join(first.union(second).distinct(), ["page_id", "seg_id"], "left_anti")


def merge_targets(decided: DataFrame) -> DataFrame:
    """(page_id, seg_id, target_id): of several targets the one that is written last, by the ranks of the pair."""
    into_a = F.col("decision") == "merge_b_into_a"
    side = lambda first, second, name: F.when(into_a, F.col(first)).otherwise(F.col(second)).alias(name)
    merged = decided.where(F.col("decision").isin("merge_b_into_a", "merge_a_into_b"))
    pairs = merged.select("page_id", side("b_seg_id", "a_seg_id", "seg_id"), side("a_seg_id", "b_seg_id", "target_id"), "a_rank", "b_rank")
    return pairs.groupBy("page_id", "seg_id").agg(F.max_by("target_id", F.struct("a_rank", "b_rank", "target_id")).alias("target_id"))


def apply_merges(segments: DataFrame, decided: DataFrame) -> DataFrame:
    """Merged segments leave, their targets' boxes grow to the joint box; outlines are joined by ``merge_outline``.

    Segments meet their targets once; merged ones and the segment they go to then lie in one window.
    """
    rows = segments.join(merge_targets(decided), ["page_id", "seg_id"], "left")
    home, moved = W.partitionBy("page_id", F.coalesce("target_id", "seg_id")), F.col("target_id").isNotNull()
    grown = {c: (F.min if c[1] == "0" else F.max)(F.when(moved, F.col(c))).over(home).alias(f"m_{c}") for c in rect.CORNERS}
    left = rows.select(*segments.columns, "target_id", *grown.values()).where("target_id is null")
    return left.select(
        *[c for c in segments.columns if c not in rect.CORNERS],
        *[(F.least if c[1] == "0" else F.greatest)(c, F.coalesce(f"m_{c}", c)).alias(c) for c in rect.CORNERS],
    )


def merge_cascade(decided: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that go because their region was merged into another."""
    gone = merge_targets(decided).select("page_id", F.col("seg_id").alias("region_id"), "target_id")
    return lines.join(gone, ["page_id", "region_id"]).select("page_id", "region_id", "line_id", "target_id")


def line_pairs(decided: DataFrame, lines: DataFrame) -> DataFrame:
    """Overlapping lines of undecided regions, and which line has the other's centre inside."""
    side = lambda p: lines.select("page_id", F.col("region_id").alias(p + "seg_id"), F.col("line_id").alias(p + "line"), *[F.col(c).alias(p + "l" + c) for c in rect.CORNERS])
    pairs = decided.where("decision like 'undecided%'").select("page_id", "a_seg_id", "b_seg_id", "a_area", "b_area")
    met = pairs.join(side("a_"), ["page_id", "a_seg_id"]).join(side("b_"), ["page_id", "b_seg_id"]).where(rect.overlap("a_l", "b_l"))

    def centre_in(a: str, b: str):
        x0, y0, x1, y1 = rect.corners(a)
        u0, v0, u1, v1 = rect.corners(b)
        return (x0 + x1 > 2 * u0) & (x0 + x1 < 2 * u1) & (y0 + y1 > 2 * v0) & (y0 + y1 < 2 * v1)

    return met.select(
        "page_id", "a_seg_id", "b_seg_id", "a_line", "b_line", "a_area", "b_area",
        rect.area("a_l").alias("a_line_area"), rect.area("b_l").alias("b_line_area"),
        centre_in("a_l", "b_l").alias("a_in_b"), centre_in("b_l", "a_l").alias("b_in_a"),
    )


def line_actions(pairs: DataFrame) -> DataFrame:
    """Merge where a centre is inside, towards the larger region; else the larger line is cut by the smaller."""
    merge = F.col("a_in_b") | F.col("b_in_a")
    larger_a = F.when(merge, F.col("a_area") > F.col("b_area")).otherwise(F.col("a_line_area") > F.col("b_line_area"))
    return pairs.select(
        "page_id", F.when(merge, "merge").otherwise("split").alias("action"),
        F.when(merge == larger_a, F.col("b_line")).otherwise(F.col("a_line")).alias("line_id"),
        F.when(merge == larger_a, F.col("a_line")).otherwise(F.col("b_line")).alias("other_id"),
    )


def segment_validity(outlines: DataFrame) -> DataFrame:
    """(.., reason): the first thing wrong with an outline (ring), null where nothing is; coordinates are cut to whole ones.

    Outlines are looked at by batches: convex ones can't cross themselves, the edges of the others are compared in pairs.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            given = flat.of_points(batch.column("ring"))
            reason = flat.problems(given._replace(x=np.trunc(given.x), y=np.trunc(given.y)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("seg_id"), pa.array(reason, pa.string())], ["page_id", "seg_id", "reason"])

    rows = outlines.select("page_id", "seg_id", "ring")
    return rows.mapInArrow(batches, f"{groups.kinds(rows, 'page_id')}, seg_id string, reason string")


def ensure_valid(outlines: DataFrame) -> DataFrame:
    """Negative points raised to 0, outlines of two points given a way back."""
    return outlines.select("page_id", "seg_id", ring.serialize(ring.ensure_valid(F.col("ring"))).alias("points"))


def clip_to_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children cut to their parents; those wholly outside become null outlines, those without a parent stay."""
    side = parents.select("page_id", F.col("seg_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in rect.CORNERS])
    met = children.join(side, ["page_id", "parent_id"], "left")
    cut = {c: (F.greatest if c[1] == "0" else F.least)(F.col(c), F.coalesce(f"p_{c}", c)) for c in rect.CORNERS}
    inside = (cut["x1"] > cut["x0"]) & (cut["y1"] > cut["y0"])
    return met.select("page_id", "seg_id", *[F.when(inside, cut[c]).alias(c) for c in rect.CORNERS])


def parent_consistency(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(page_id, parent_id, seg_id, action): none for children within their parent, else clip or drop."""
    side = parents.select("page_id", F.col("seg_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in rect.CORNERS])
    met = children.select("page_id", "parent_id", "seg_id", *[F.col(c).alias(f"c_{c}") for c in rect.CORNERS]).join(side, ["page_id", "parent_id"])
    action = F.when(rect.within("c_", "p_"), "none").when(rect.overlap("c_", "p_"), "clip").otherwise("drop")
    return met.select("page_id", "parent_id", "seg_id", action.alias("action"))


def error_resolve(errors: DataFrame, segments: DataFrame) -> DataFrame:
    """Reported errors with the segment they name, ``found`` telling whether it exists."""
    known = segments.select("page_id", "seg_id", F.lit(True).alias("hit"))
    return errors.join(known, ["page_id", "seg_id"], "left").select("page_id", "seg_id", "reason", F.col("hit").isNotNull().alias("found"))


def neighbor_overlap(segments: DataFrame) -> DataFrame:
    """Neighbours worth a warning: intersection over union within a class; the inner one's share across classes."""
    side = lambda p: segments.select("page_id", *[F.col(c).alias(p + c) for c in ("seg_id", "seg_class", *rect.CORNERS)])
    met = side("a_").join(side("b_"), "page_id").where((F.col("a_seg_id") < F.col("b_seg_id")) & rect.overlap("a_", "b_"))
    inter, alike = rect.intersection("a_", "b_"), F.col("a_seg_class") == F.col("b_seg_class")
    inner = rect.within("a_", "b_") | rect.within("b_", "a_")
    a, b = rect.area("a_"), rect.area("b_")
    value = F.when(alike, inter / (a + b - inter)).otherwise(F.least(a, b) / F.greatest(a, b))
    return met.where(alike | inner).select("page_id", "a_seg_id", "b_seg_id", F.when(alike, "iou").otherwise("within").alias("kind"), F.round(value, 6).alias("value"))


def project_bbox(children: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """Parents' boxes from their children, padded and cut to the page."""
    hull = children.groupBy("page_id", "parent_id").agg(*[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in rect.CORNERS])
    return hull.select(
        "page_id", "parent_id",
        *[F.greatest(F.col(c) - padding, F.lit(0)).alias(c) for c in ("x0", "y0")],
        F.least(F.col("x1") + padding, F.lit(width)).alias("x1"), F.least(F.col("y1") + padding, F.lit(height)).alias("y1"),
    )
