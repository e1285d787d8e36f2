"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Documents are put in a seeded order (MD5 of seed and doc_id) within their source and shard, and cut into blocks of
``BLOCK_TOKENS`` tokens; a document belongs to the block in which it begins, so a block's size is exact up to the
documents at its ends. ``FRACTION`` of all blocks are then allocated to sources, each block to the source with the
highest quotient weight / (2 x blocks so far + 1) among those that have blocks left; a source's quota is apportioned to
its shards by the same rule with their block counts as weights. Every shard finally takes its quota of blocks, those
with the lowest seeded hashes, and keeps the documents in them.

Only (source, shard) totals reach the apportionment; the order, the cut and the selection are distributed. Running
sums are made on two levels: the order is that of a hash, its leading digits cut every source and shard into ``RANGES``
ranges, whose totals are summed up first, so that a source with a third of all documents is spread over thousands of
tasks.

Defined results: tokens are words between spaces, so null and empty texts have none and stay with the block in which
they fall; a text of any length is one unit and never cut; a null source is a source of its own, ''; rows with a null doc_id have the order of an empty id; repeated
rows with one doc_id and source are one unit and stay or go together; ties between quotients go to the source, then to
the shard, that sorts first; extra columns, of any names, are ignored (``choose``) or kept (``mix``); an empty table gives an
empty result; sources without a given weight weigh ``DEFAULT_WEIGHT``, and a weight of 0 or less gives no block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

BLOCK_TOKENS = 2048
SHARDS = 8
#: Leading hexadecimal digits of a hash that make a range, and the ranges.
DIGITS, RANGES = 3, 4096
FRACTION = 0.6
SEED = 17
DEFAULT_WEIGHT = 1.0
#: Target weights; the rest of the sources weigh DEFAULT_WEIGHT.
WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 3.0, "src3": 2.0, "src4": 2.0, "src5": 0.5}


def apportion(weights: list[float], limits: list[int], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), none beyond its limit; ties to the first.

    The k-th seat of an entry has a fixed quotient, so the seats are the highest quotients overall. They are counted
    above a cut that is found by bisection, and only those near the cut are sorted: the cost doesn't grow with seats.
    """
    w = np.maximum(np.nan_to_num(np.asarray(weights, float)), 0)
    cap = np.where(w > 0, np.asarray(limits, np.int64), 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(w)

    def above(cut: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.minimum(cap, np.maximum(0, np.ceil((w / cut - 1) / 2))).astype(np.int64)

    low, high = 0.0, float(w.max()) * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if above(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    got = np.maximum(0, above(high * (1 + 1e-9)) - 1)
    rest = seats - int(got.sum())
    near = [(-w[i] / (2 * k + 1), i) for i in range(len(w)) for k in range(got[i], min(cap[i], got[i] + 4))]
    for _, i in sorted(near)[:rest]:
        got[i] += 1
    return got.tolist()


def _units(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """(doc_id, source, shard, mark, tokens), a row for each doc_id and source."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")), F.lit(0))
    return (
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), runs.cast("long").alias("tokens"))
        .groupBy("doc_id", "source")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("mark", F.md5(F.concat(F.lit(f"{seed}:"), id_text)))
        .withColumn("shard", F.pmod(F.conv(F.substring("mark", 1, 6), 16, 10).cast("long"), F.lit(shards)))
    )


def _running(rows: DataFrame, value: Column, *order: Column | str) -> DataFrame:
    """rows (source, shard, mark, ..) with ``before``: the sum of value over the rows before, in the order of mark."""
    rows = rows.withColumn("_range", F.substring("mark", 1, DIGITS)).withColumn("_value", value)
    whole = rows.groupBy("source", "shard", "_range").agg(F.sum("_value").alias("_total"))
    earlier = F.sum("_total").over(W.partitionBy("source", "shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    within = F.sum("_value").over(W.partitionBy("source", "shard", "_range").orderBy("mark", *order).rowsBetween(W.unboundedPreceding, -1))
    offsets = whole.select("source", "shard", "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    return (
        rows.withColumn("_within", F.coalesce(within, F.lit(0)))
        .join(offsets, ["source", "shard", "_range"])
        .withColumn("before", F.col("_earlier") + F.col("_within"))
        .drop("_range", "_value", "_within", "_earlier")
    )


def _blocks(units: DataFrame, block: int) -> DataFrame:
    placed = _running(units, F.col("tokens"), F.col("doc_id").asc_nulls_first())
    return placed.withColumn("block", F.floor(F.col("before") / block).cast("long")).drop("before")


def choose(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    fraction: float = FRACTION,
    block: int = BLOCK_TOKENS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, shard, block, tokens) of the documents in the chosen blocks."""
    weights = WEIGHTS if weights is None else weights
    placed = _blocks(common.durable(_units(docs, shards, seed)), block)
    blocks = placed.groupBy("source", "shard", "block").agg(F.count("*").alias("n"))
    totals = blocks.groupBy("source", "shard").agg(F.count("*").alias("blocks")).toPandas()
    quotas = quotas_of(totals, weights, fraction)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(r.source, int(r.shard), int(r.quota)) for r in quotas.itertuples()], "source string, shard long, quota long"
    )
    mark = F.md5(F.concat_ws(":", F.lit(f"{seed}"), "source", "shard", "block"))
    taken = (
        _running(blocks.select("source", "shard", "block", mark.alias("mark")), F.lit(1), "block")
        .join(table, ["source", "shard"])
        .where("before < quota")
        .select("source", "shard", "block")
    )
    return placed.join(taken, ["source", "shard", "block"]).select("doc_id", "source", "shard", "block", "tokens")


def quotas_of(totals: pd.DataFrame, weights: dict[str, float], fraction: float) -> pd.DataFrame:
    """totals (source, shard, blocks), with the quota of each shard."""
    totals = totals.sort_values(["source", "shard"]).reset_index(drop=True)
    totals["quota"] = 0
    names = sorted(totals["source"].unique())
    limits = [int(totals.loc[totals["source"] == s, "blocks"].sum()) for s in names]
    seats = apportion([weights.get(s, DEFAULT_WEIGHT) for s in names], limits, int(sum(limits) * fraction))
    for name, quota in zip(names, seats, strict=True):
        own = totals.index[totals["source"] == name]
        held = totals.loc[own, "blocks"].tolist()
        totals.loc[own, "quota"] = apportion([float(x) for x in held], held, quota)
    return totals


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose documents are chosen, with all their columns."""
    chosen = choose(docs, **options).select("doc_id", F.col("source").alias("_source"))
    own = F.coalesce(docs["source"], F.lit(""))
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"]) & (own == chosen["_source"]), "left_semi")


def oracle_sql(fraction: float = FRACTION, block: int = BLOCK_TOKENS, shards: int = SHARDS, seed: int = SEED, docs: str = "documents") -> str:
    """The same choice in SQL, with every quotient listed and ranked."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
    return f"""
WITH units AS (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(sum(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) END) AS BIGINT) AS tokens,
         md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS mark
  FROM {docs} GROUP BY doc_id, coalesce(source, '')),
sharded AS (SELECT *, CAST(concat('0x', substr(mark, 1, 6)) AS BIGINT) % {shards} AS shard FROM units),
placed AS (
  SELECT doc_id, source, shard, tokens, CAST(floor(coalesce(sum(tokens) OVER (
           PARTITION BY source, shard ORDER BY mark, doc_id NULLS FIRST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {block}) AS BIGINT) AS block
  FROM sharded),
blocks AS (SELECT DISTINCT source, shard, block FROM placed),
shard_totals AS (SELECT source, shard, count(*) AS n FROM blocks GROUP BY source, shard),
source_totals AS (
  SELECT source, sum(n) AS n, CAST(CASE source {cases} ELSE {DEFAULT_WEIGHT} END AS DOUBLE) AS weight
  FROM shard_totals GROUP BY source),
source_seats AS (
  SELECT source, row_number() OVER (ORDER BY weight / (2 * k + 1) DESC, source) AS seat
  FROM source_totals, unnest(generate_series(0, CAST(n AS BIGINT) - 1)) AS t(k) WHERE weight > 0),
source_quota AS (
  SELECT source, count(*) AS quota FROM source_seats
  WHERE seat <= (SELECT floor(sum(n) * {fraction}) FROM source_totals) GROUP BY source),
shard_seats AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY n / (2 * k + 1) DESC, shard) AS seat
  FROM (SELECT source, shard, CAST(n AS DOUBLE) AS n, k
        FROM shard_totals, unnest(generate_series(0, CAST(n AS BIGINT) - 1)) AS t(k))),
shard_quota AS (
  SELECT s.source, s.shard, count(*) AS quota FROM shard_seats s JOIN source_quota q USING (source)
  WHERE s.seat <= q.quota GROUP BY s.source, s.shard),
ranked AS (
  SELECT source, shard, block, row_number() OVER (PARTITION BY source, shard
           ORDER BY md5(concat('{seed}:', source, ':', shard, ':', block)), block) AS rank FROM blocks),
taken AS (SELECT r.source, r.shard, r.block FROM ranked r JOIN shard_quota q USING (source, shard) WHERE r.rank <= q.quota)
SELECT p.doc_id, p.source, CAST(p.shard AS BIGINT) AS shard, p.block, p.tokens
FROM placed p JOIN taken t USING (source, shard, block)
"""
