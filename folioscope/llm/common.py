"""Small helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """df, materialised in the checkpoint folder that the cluster shares, so that lost executors cost nothing.

    The folder is that of ``spark.checkpoint.dir``. Only a local session that names none gets one of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioscope-"))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more, once their result is durable."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def lean(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """batches, giving a worker's free memory back once its task is done: workers are used again by later stages."""

    def run(found: Iterator) -> Iterator:
        try:
            yield from batches(found)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows, those with the lowest seeded hashes of ``key``: the same rows in any partitioning.

    For fitting models only. The count comes from file footers, the filter leaves about a third more than needed.
    """
    total = df.count()
    mark = F.xxhash64(F.lit(seed), F.col(key))
    if total > rows * 1.5:
        df = df.where(F.pmod(mark, F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows * 1.35 / total)))
    return df.orderBy(mark).limit(rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for every node of edges (a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014): a logarithmic number of rounds, no vertex ever
    gathers more than its own neighbours. Each round is written to the shared checkpoint folder.
    """
    links = durable(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.toDF("u", "v").where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.toDF("u", "v").join(low, "u")
        links = durable(
            small.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(small.select(F.col("u"), F.col("m")))
            .where("a != b")
            .distinct()
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select("b", "b").distinct()
            )
        before = now
