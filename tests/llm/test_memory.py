"""That workers hold a bounded amount for each row, whatever the rows are."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import simhash


def fingerprints(n: int, group: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Random fingerprints with word counts; those of a group differ in 3 bits of its first at most."""
    rng = np.random.default_rng(8)
    first = rng.integers(0, 1 << 63, (n // group, 2), np.uint64) * np.uint64(2) + rng.integers(0, 2, (n // group, 2), np.uint64)
    prints, words = np.repeat(first, group, axis=0), np.repeat(rng.integers(100, 2000, n // group), group)
    for _ in range(3 * (group > 1)):
        prints[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return prints, words


def least(links: np.ndarray, n: int) -> list[int]:
    """The least row of each one's component."""
    return simhash._linked(np.arange(n), *links.T).tolist()


@pytest.mark.parametrize("group", [1, 500])
def test_comparing_a_cell_takes_few_bytes_a_fingerprint(group):
    prints, words = fingerprints(100_000, group)
    masks = np.concatenate(simhash.key_masks(4))[::50]
    tracemalloc.start()
    links = simhash.cell_edges(prints, words, masks, simhash.references())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * len(prints)
    assert len(links) >= 0.9 * (len(prints) - len(prints) // group)


def test_cells_are_the_values_of_the_common_bits():
    prints, _ = fingerprints(5_000)
    for masks, prefix in simhash.key_sets(simhash.key_masks(3), 4)[:5]:
        cell = simhash._bits(prints, prefix)
        assert set(cell.tolist()) == set(range(16))
        assert len({(c, *p) for c, p in zip(cell.tolist(), (prints & prefix).tolist(), strict=True)}) == 16
        assert ((prefix & masks) == prefix).all()


def test_cells_that_are_too_large_lose_no_link(monkeypatch):
    prints, words = fingerprints(3_000, 6)
    masks = np.concatenate(simhash.key_masks(4))[::10]
    rows = np.column_stack([prints.view(np.int64), words])
    number = {x: k for k, x in enumerate(simhash.nodes(prints, words).tolist())}

    def linked() -> list[int]:
        found = [x for batch in simhash._edges(rows, masks, simhash.references()) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        return least(np.array([[number[a], number[b]] for a, b in found]), len(rows))

    whole = linked()
    monkeypatch.setattr(simhash, "CELL", 100)
    sizes = [len(simhash.nodes(prints, words)[some]) for some, _ in simhash._pieces(prints, masks)]
    assert max(sizes) <= 100 and sum(sizes) == len(masks) * len(rows)
    assert linked() == whole and whole != list(range(len(rows)))


def test_a_task_sends_and_compares_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 500)
    monkeypatch.setattr(simhash, "SENT", 10_000, raising=False)
    frames, kind = [], type(spark.range(1))
    whole = kind.mapInArrow

    def seen(df, batches, schema):
        frames.append(df)
        return whole(df, batches, schema)

    monkeypatch.setattr(kind, "mapInArrow", seen)
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.md5(F.concat_ws(" ", k, "doc_id")))
    docs = spark.range(0, 4_000, 1, 1).select(F.col("id").alias("doc_id")).withColumn("text", F.concat_ws(" ", words))
    assert simhash.groups(docs).count() == 0
    sending, comparing = (df for df in frames if "fa" in df.columns)
    places = comparing.select("place", F.spark_partition_id().alias("at")).distinct()
    sets = places.count() // 8
    sent = [r["count"] for r in sending.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sent) == 4_000 and max(sent) * sets < 1.5 * simhash.SENT
    assert places.groupBy("at").count().where("count > 1").isEmpty()
