"""File lists and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def filelist(lines: DataFrame) -> DataFrame:
    """(row, gt, dt, image) of tab-separated lines (row, line) with two columns or three, the same number in all.

    A line with another number of columns than the first ends the job with an error.
    """
    first = lines.orderBy("row").limit(1).select(F.size(F.split(F.trim("line"), "\t"))).first()
    wide = first[0] if first else 2
    if not 2 <= wide <= 3:
        raise ValueError("a list has tab-separated columns: truth, prediction and, if any, image")
    parts = F.split(F.trim("line"), "\t")
    checked = F.when(F.size(parts) == wide, parts).otherwise(F.raise_error(F.concat(F.lit("not as many columns as the first line: "), "line")))
    return lines.select("row", checked.alias("p")).select("row", F.get("p", F.lit(0)).alias("gt"), F.get("p", F.lit(1)).alias("dt"), F.get("p", F.lit(2)).alias("image"))


def parallel(gt: DataFrame, dt: DataFrame, image: DataFrame | None = None) -> DataFrame:
    """The same from lists (row, line) of one column each, which must have the same rows."""
    side = lambda frame, name: frame.select("row", F.trim("line").alias(name))
    both = side(gt, "gt").join(side(dt, "dt"), "row", "full_outer")
    both = both.join(side(image, "image"), "row", "full_outer") if image is not None else both.withColumn("image", F.lit(None).cast("string"))
    missing = F.col("gt").isNull() | F.col("dt").isNull() | (F.col("image").isNull() if image is not None else F.lit(False))
    return both.select("row", F.when(missing, F.raise_error(F.lit("lists of different lengths"))).otherwise(F.col("gt")).alias("gt"), "dt", "image")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, line) of a text file, in its order: one small file is one partition."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n+$", ""), "\n")).alias("row", "line"))


def text_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text): whole text files that a pattern matches, blanks at their ends cut off."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.btrim("value", F.lit(" \t\r\n")).alias("text"))
