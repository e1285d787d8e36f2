"""That sharding moves its passages once."""

from __future__ import annotations

import pytest

from folioscope.llm import common, sharding


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").cache()


def test_all_passages_are_exchanged_once(docs, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(common, "durable", seen)
    assert sharding.links(docs).count()
    assert plans[0].count("Exchange") == 1


def test_only_parted_passages_are_joined_back(docs, monkeypatch):
    packed = sharding._packed(sharding.links(docs)).cache()
    labels = sharding.assign(docs, shards=4).cache()
    shards = {r.doc_id: r.shard for r in labels.collect()}
    members = {}
    for r in sharding._marked(packed, labels).collect():
        members.setdefault(r.passage, set()).add(r.doc_id)
    several = {p for p, ids in members.items() if len({shards[x] for x in ids}) > 1}
    parted = sharding._parted(packed, labels).collect()
    assert {r.passage for r in parted} == several and 0 < len(several) < len(members) / 2
    assert all(r.n == sum(shards[x] == r.k for x in members[r.passage]) for r in parted)
    assert abs(sharding._weight(sharding._parted(packed, labels)) - sharding.cut(sharding.links(docs), labels)[0]) < 1e-6


def test_gains_are_those_of_all_passages(docs):
    edges, labels = sharding.links(docs).cache(), sharding.assign(docs, shards=4, rounds=1).cache()
    rows, shards = edges.collect(), {r.doc_id: r.shard for r in labels.collect()}
    counts = {}
    for r in rows:
        counts.setdefault(r.passage, [0] * 4)[shards[r.doc_id]] += 1
    pulls = {}
    for r in rows:
        each = pulls.setdefault(r.doc_id, [0.0] * 4)
        for k, n in enumerate(counts[r.passage]):
            each[k] += r.weight * (n - (k == shards[r.doc_id])) / (r.size - 1)
    want = {x: max(each) - each[shards[x]] for x, each in pulls.items() if max(each) - each[shards[x]] > 1e-9}
    found = {r.doc_id: (r.gain, pulls[r.doc_id][r.to] - pulls[r.doc_id][r.shard]) for r in sharding.wishes(edges, labels).collect()}
    assert found.keys() == want.keys() and want
    assert all(abs(gain - want[x]) < 1e-9 and abs(other - want[x]) < 1e-9 for x, (gain, other) in found.items())
