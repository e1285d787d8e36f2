"""Layout tables derived from ``lineitem``, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rect

#: Common table expressions seg_gt, seg_dt, seg_dup and seg_line.
LAYOUT = """
li AS (
  SELECT l_orderkey AS page_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
         CAST(l_quantity AS BIGINT) AS q, l_returnflag AS rf, l_linestatus AS ls,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn
  FROM lineitem),
base AS (
  SELECT page_id, CONCAT('r', CAST(rn AS VARCHAR(10))) AS seg_id, pk, sk,
         CASE WHEN ls = 'O' THEN 'TextRegion' ELSE 'TableRegion' END AS seg_class,
         CASE WHEN ls = 'O' THEN CASE rf WHEN 'A' THEN 'paragraph' WHEN 'N' THEN 'heading'
                                         ELSE 'caption' END END AS subtype,
         (pk * 37 + ln * 101) % 400 AS x0, (sk * 53 + q * 29) % 600 AS y0,
         40 + (q * 7) % 160 AS w, 30 + (pk * 11) % 120 AS h
  FROM li),
seg_gt AS (
  SELECT page_id, seg_id, seg_class, subtype, CAST(1.0 AS DOUBLE) AS conf,
         x0, y0, x0 + w AS x1, y0 + h AS y1 FROM base),
seg_dt AS (
  SELECT page_id, CONCAT(seg_id, 'a') AS seg_id, seg_class, subtype,
         CAST((pk % 100) / 100.0 AS DOUBLE) AS conf,
         x0 + (pk % 11) - 5 AS x0, y0 + (sk % 7) - 3 AS y0,
         CASE WHEN pk % 5 = 0 THEN x0 + CAST(FLOOR(w / 2.0) AS BIGINT) ELSE x0 + w END AS x1,
         y0 + h AS y1
  FROM base WHERE sk % 10 <> 0
  UNION ALL
  SELECT page_id, CONCAT(seg_id, 'b'), seg_class, subtype, CAST((pk % 100) / 100.0 AS DOUBLE),
         x0 + CAST(FLOOR(w / 2.0) AS BIGINT), y0, x0 + w, y0 + h
  FROM base WHERE sk % 10 <> 0 AND pk % 5 = 0
  UNION ALL
  SELECT page_id, CONCAT(seg_id, 'c'), seg_class, subtype, CAST((pk % 100) / 100.0 AS DOUBLE),
         x0 + 1000, y0, x0 + w + 1000, y0 + h
  FROM base WHERE pk % 17 = 0),
seg_dup AS (
  SELECT page_id, seg_id, seg_class, subtype, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM base
  UNION ALL
  SELECT page_id, CONCAT(seg_id, 'x'), seg_class, subtype, x0, y0, x0 + w, y0 + h
  FROM base WHERE pk % 19 = 0
  UNION ALL
  SELECT page_id, CONCAT(seg_id, 'y'), seg_class, subtype, x0 + 3, y0 + 3, x0 + w - 3, y0 + h - 3
  FROM base WHERE pk % 23 = 0
  UNION ALL
  SELECT page_id, CONCAT(seg_id, 'z'), seg_class, subtype, x0 + 1, y0 + 1, x0 + w + 1, y0 + h + 1
  FROM base WHERE pk % 29 = 0),
seg_line AS (
  SELECT d.page_id, d.seg_id AS region_id, CONCAT(d.seg_id, '_l', CAST(k.k AS VARCHAR(3))) AS line_id, k.k AS pos,
         d.x0, d.x1,
         d.y0 + k.k * CAST(FLOOR((d.y1 - d.y0) / 3.0) AS BIGINT) AS y0,
         d.y0 + (k.k + 1) * CAST(FLOOR((d.y1 - d.y0) / 3.0) AS BIGINT) AS y1
  FROM seg_dup d CROSS JOIN (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k
  WHERE d.seg_class = 'TextRegion')
"""


#: Bytes of the line items' files for which there is one partition of pages; some 200,000 to 400,000 segments.
PART = 4 << 20
#: Suffix, condition and corners of the segments that one row of ``base`` stands for, as in seg_dt and seg_dup.
PREDICTED = (
    ("a", "sk % 10 <> 0", "x0 + (pk % 11) - 5", "y0 + (sk % 7) - 3", "CASE WHEN pk % 5 = 0 THEN x0 + w div 2 ELSE x0 + w END", "y0 + h"),
    ("b", "sk % 10 <> 0 AND pk % 5 = 0", "x0 + w div 2", "y0", "x0 + w", "y0 + h"),
    ("c", "pk % 17 = 0", "x0 + 1000", "y0", "x0 + w + 1000", "y0 + h"),
)
REDUNDANT = (
    ("", "true", "x0", "y0", "x0 + w", "y0 + h"), ("x", "pk % 19 = 0", "x0", "y0", "x0 + w", "y0 + h"),
    ("y", "pk % 23 = 0", "x0 + 3", "y0 + 3", "x0 + w - 3", "y0 + h - 3"), ("z", "pk % 29 = 0", "x0 + 1", "y0 + 1", "x0 + w + 1", "y0 + h + 1"),
)


def _lineitem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The line items, and how many partitions they are for."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = int(lineitem._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return lineitem, max(spark.sparkContext.defaultParallelism, -(-size // PART))


def _parted(lineitem: DataFrame, parts: int) -> DataFrame:
    """Whole pages in partitions whose number grows with the input, so that no later step by page exchanges them again."""
    return lineitem.repartition(parts, "l_orderkey")


def sized(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query in a session of its own, with the caller's settings but for two.

    Exchanges have partitions in number with the input, so that what a task holds doesn't grow with it, and rows that
    lie together by page aren't exchanged for joins by page and more.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if own.conf.isModifiable(key):
                own.conf.set(key, value)
        try:
            own.conf.set("spark.sql.shuffle.partitions", max(int(spark.conf.get("spark.sql.shuffle.partitions")), _lineitem(spark, sf_dir)[1]))
        except AnalysisException:
            pass  # Queries on other tables don't need line items.
        own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return query(own, sf_dir)

    return run


def _each(base: DataFrame, kinds: tuple) -> DataFrame:
    """The segments of all kinds in one pass over ``base``, where the SQL unites a pass for each kind."""
    made = [F.when(F.expr(when), F.struct(F.lit(suffix).alias("suffix"), *[F.expr(e).alias(c) for c, e in zip(rect.CORNERS, corners, strict=True)])) for suffix, when, *corners in kinds]
    conf = F.expr("(pk % 100) / 100D").alias("conf")
    rows = base.select("page_id", "seg_id", "seg_class", "subtype", conf, F.inline(F.array(*made))).where("suffix is not null")
    return rows.withColumn("seg_id", F.concat("seg_id", "suffix")).drop("suffix")


def layout(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of LAYOUT; segments are rectangles of whole numbers, pages are orders."""
    lineitem = _parted(*_lineitem(spark, sf_dir))
    table = lambda name: spark.sql(f"WITH {LAYOUT.replace('FROM lineitem', 'FROM {lineitem}')} SELECT * FROM {name}", lineitem=lineitem)
    if name == "seg_dt":
        return _each(table("base"), PREDICTED)
    if name == "seg_dup":
        return _each(table("base"), REDUNDANT).drop("conf")
    if name == "seg_line":
        k = F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k")) for k in range(3)]))
        rows = _each(table("base").where("seg_class = 'TextRegion'"), REDUNDANT).select("page_id", F.col("seg_id").alias("region_id"), *rect.CORNERS, k)
        high = "(y1 - y0) div 3"
        return rows.select("page_id", "region_id", F.expr("concat(region_id, '_l', cast(k as string))").alias("line_id"), F.col("k").alias("pos"), "x0", "x1", F.expr(f"y0 + k * ({high})").alias("y0"), F.expr(f"y0 + (k + 1) * ({high})").alias("y1"))
    return table(name)
