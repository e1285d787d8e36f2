"""That passages are moved in packs and counted whole, however many a worker holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import common, sharding


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(1, "again " * 40), (1, "again " * 40), (10**6, "a line of its own\n" + "A" * 30 + " \n"), (10**6, "  " + "a" * 30), (10**6 + 1, "a" * 30)]
    odd += [(10**6 + k, "a line that many of the documents hold, word for word") for k in range(2, 60)] + [(None, "a" * 30), (10**6 + 99, None)]
    return docs.union(spark.createDataFrame(odd, docs.schema)).cache()


@pytest.fixture(scope="module")
def wanted(table):
    """{documents: number of passages that just these share}, counted without Spark."""
    rows = [r for r in table.collect() if r.doc_id is not None and r.text is not None]
    members = {}
    for r, (doc, marks) in ((r, sharding.winnowed(pa.array([r.text]))) for r in rows):
        lines = (x for x in r.text.lower().split("\n") if len(x) >= sharding.MIN_CHARS)
        for passage in [*marks.tolist(), *(x.strip(" ") for x in lines)]:
            members.setdefault(passage, set()).add(r.doc_id)
    counts = {}
    for ids in members.values():
        if len(ids) > 1:
            counts[frozenset(ids)] = counts.get(frozenset(ids), 0) + 1
    return counts


@pytest.mark.parametrize("held", [sharding.HELD, 40])
def test_links_are_whole_at_any_memory(table, wanted, monkeypatch, held):
    monkeypatch.setattr(sharding, "HELD", held)
    members, sizes = {}, {}
    for r in sharding.links(table).collect():
        members.setdefault(r.passage, set()).add(r.doc_id)
        sizes.setdefault(r.passage, set()).add((r.size, r.weight))
    found = {frozenset(ids): sizes[p] for p, ids in members.items()}
    assert len(found) == len(members)
    assert found == {ids: {(len(ids), n)} for ids, n in wanted.items()} and len(found) > 50


def test_passages_are_neither_moved_nor_sorted_one_by_one(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(common, "durable", seen)
    sharding.links(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert not any(x in plans[0] for x in ("Window", "Sort", "Union", "Generate"))


@pytest.mark.parametrize("limit", [100, 1000, 10**6])
def test_counts_of_split_passages(limit):
    rng = np.random.default_rng(1)
    rows = np.stack([sharding.textkit.mix(rng.integers(0, 900, 6000).astype(np.uint64)), rng.integers(0, 1200, 6000).astype(np.uint64)])
    rows[0, :2000] = 7  # a passage that no bits part
    several = {}
    for passage, doc in rows.T.tolist():
        several.setdefault(passage, set()).add(doc)
    found = np.concatenate(list(sharding._common(np.array_split(rows, 13, axis=1), limit)), axis=1)
    assert sorted(map(tuple, found[:3].T.tolist())) == sorted((p, doc, len(ids)) for p, ids in several.items() if len(ids) > 1 for doc in ids)
    assert sorted(map(tuple, found.T.tolist())) == sorted(map(tuple, sharding._counted(rows).T.tolist()))


def test_lines_are_the_same_but_for_case_and_outer_blanks():
    texts = ["", None, "Aaaa bbbb \n  cccc\n\n", "ΟΔΟΣ a", "  οδος A ", "      ", "é" * 4 + "\n" + "É" * 4, "\n", "aaaa bbbb"]
    doc, marks = sharding.long_lines(pa.array(texts), 4)
    assert doc.tolist() == [2, 2, 3, 4, 5, 6, 6, 8]
    assert marks[0] == marks[7] and marks[2] == marks[3] and marks[5] == marks[6] and len(set(marks.tolist())) == 5
