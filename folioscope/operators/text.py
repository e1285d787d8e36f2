"""Texts into trees, and page metadata across versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def text_attach(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Files to segments: the page's name occurs in the path, whose stem ends with the segment's id.

    The page number in the path is the join key, so that only segments of the right page are compared; of several the
    innermost level wins, then the first in document order.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.gt)?\.txt$", "")
    named = files.select("path", "page_name", stem.alias("stem"))
    met = named.join(segments, "page_name").where(F.expr("endswith(stem, seg_id)"))
    by = W.partitionBy("path")
    ranked = met.withColumn("k", F.row_number().over(by.orderBy("level_rank", "pos", "seg_id"))).withColumn("n", F.count("*").over(by))
    return ranked.where("k = 1").select("path", "seg_id", (F.col("n") > 1).alias("ambiguous"))


def text_insert(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """File contents, stripped, as a new first alternative before those there are; segments without a file stay."""
    new = texts.select("page_id", "turn", F.btrim("content", F.lit(" \t\r\n")).alias("new"))
    rows = segments.join(new, ["page_id", "turn"], "left")
    return rows.select("page_id", "turn", F.when(F.col("new").isNotNull(), F.array_prepend("alternatives", F.col("new"))).otherwise(F.col("alternatives")).alias("alternatives"))


def update_counts(segments: DataFrame, updated: DataFrame) -> DataFrame:
    """How many segments of each class got a text and how many didn't."""
    marked = segments.join(updated.select("page_id", "seg_id", F.lit(1).alias("hit")), ["page_id", "seg_id"], "left")
    return marked.groupBy("seg_class").agg(F.count("hit").alias("updated"), F.count(F.when(F.col("hit").isNull(), 1)).alias("missing"))


def page_pairs(gt: DataFrame, dt: DataFrame) -> DataFrame:
    """Pages of two versions, with the side that lacks one."""
    a, b = gt.select("page_id").distinct().withColumn("g", F.lit(True)), dt.select("page_id").distinct().withColumn("d", F.lit(True))
    status = F.when(F.col("g").isNull(), "no_gt").when(F.col("d").isNull(), "no_dt").otherwise("both")
    return a.join(b, "page_id", "full_outer").select("page_id", status.alias("status"))


def unmatched(images: DataFrame, pages: DataFrame) -> DataFrame:
    return images.join(pages, "page_id", "left_anti").select("page_id")


def replace_page(metadata: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of one version under the page metadata of another."""
    return segments.join(metadata, "page_id").select("page_id", "width", "height", "seg_id", "seg_class")
