"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: values, operator by operator.

The pipeline's stages are held against brute-force decisions on the rows that each is given.
"""

from __future__ import annotations

import base64
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from folioscope.llm import bpe, covertree, langid, licenses, lm, mixing, neighbours, sharding, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem " * 60_000
EDGES = [
    (None, "no id here but an idiot", "en", "a", 5),
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, LONG, "en", "a", 360_000),
    (4, "same text here", "en", "b", 14),
    (4, "same text here", "en", "b", 14),
    (5, "Same text, here!", "en", "b", 16),
    (6, "Released under the MIT License. you idiot", None, None, 40),
]


@pytest.fixture(scope="module")
def edges(spark):
    """Rows with every edge case, beside columns whose names clash with results and helpers."""
    table = spark.createDataFrame(EDGES, DOCS)
    for name in ("score", "tokens", "shard", "row", "place", "block", "mark", "before", "gram", "segment", "keep_id", "label", "_label", "size"):
        table = table.withColumn(name, F.lit("clash"))
    return table


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_language(spark, edges, empty):
    model = langid.train(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    rows = by_id(langid.identify(edges, model).collect())
    assert {k: len(v) for k, v in rows.items()} == {None: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}
    assert [(rows[k][0].lang_pred, rows[k][0].confidence) for k in (1, 2)] == [("und", 0.0)] * 2
    assert rows[4][0] == rows[4][1] and rows[1][0].p_declared is None and rows[3][0].confidence > 0
    kept = langid.reject(edges, model)
    assert kept.columns == edges.columns and not {1, 2} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in langid.identify(edges, None).collect()} == {"und"}
    assert langid.train(empty) is None and langid.identify(empty, model).collect() == []


def test_toxicity(spark, edges, empty):
    lexicon = toxicity.learn(edges, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert lexicon.terms == sorted(toxicity.SEEDS)
    rows = toxicity.score(edges, lexicon).collect()
    assert sorted(((r.doc_id or 0), r.score, r.hits, r.terms) for r in rows) == [(0, 1.0, 1, ["idiot"]), (6, 1.0, 1, ["idiot"])]
    kept = toxicity.reject(edges, lexicon)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 4, 5]
    assert toxicity.score(empty, lexicon).collect() == []
    # Ties go to the term that sorts first.
    assert toxicity.Lexicon(["grobians", "grobianz"]).match("grobianx") == ("grobians", 1)
    far = spark.createDataFrame([(1, LONG + "idiot")], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.score(far, lexicon).collect()] == [1]


def test_simhash(edges, empty):
    assert sorted(map(tuple, simhash.duplicates(edges).collect())) == [(5, 4)]
    kept = simhash.deduplicate(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 4), (True, 4), (True, 6)]
    assert simhash.duplicates(empty).collect() == []


def test_mixing(edges, empty):
    rows = by_id(mixing.choose(edges, weights={}, fraction=1.0, block=4).collect())
    assert {k: [(r.source, r.tokens) for r in v] for k, v in rows.items()} == {
        None: [("a", 6)], 1: [("", 0)], 2: [("a", 0)], 3: [("a", 60_000)], 4: [("b", 6)], 5: [("b", 3)], 6: [("", 7)],
    }
    mixed = mixing.mix(edges, weights={}, fraction=1.0, block=4)
    assert mixed.columns == edges.columns and mixed.count() == len(EDGES)
    assert {r.source for r in mixing.choose(edges, weights={"a": 0.0}, fraction=1.0, block=4).collect()} == {"", "b"}
    assert mixing.choose(empty).collect() == []
    assert mixing.apportion([1.0, 1.0, 1.0], [5, 5, 5], 4) == [2, 1, 1]


def test_bpe(edges, empty):
    rows = by_id(bpe.encode(edges).collect())
    assert rows[1][0].tokens is None and rows[1][0].n_tokens == 0 and rows[2][0].tokens == []
    assert rows[3][0].n_tokens >= 60_000 and all(r.round_trip for v in rows.values() for r in v)
    assert rows[4][0] == rows[4][1] and bpe.encode(edges).columns.count("tokens") == 1
    assert bpe.encode(empty).collect() == []


def test_licenses(spark, edges, empty):
    assert list(map(tuple, licenses.scan(edges).collect())) == [(6, "MIT notice", 1.0, 5, 1)]
    assert licenses.scan(empty).collect() == []
    far = spark.createDataFrame([(None, LONG + licenses.TEMPLATES["ISC"]), (7, None)] + [(8, licenses.TEMPLATES["MIT"])] * 2, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license, r.coverage) for r in licenses.scan(far).collect()) == [(0, "ISC", 1.0), (8, "MIT", 1.0), (8, "MIT", 1.0)]


def test_lm(edges, empty):
    rows = by_id(lm.score(edges, lm.train(edges)).collect())
    assert [(rows[k][0].n_words, rows[k][0].log_prob, rows[k][0].perplexity) for k in (1, 2)] == [(0, 0.0, None)] * 2
    assert rows[3][0].n_words == 60_000 and rows[None][0].n_words == 6
    assert rows[4][0] == rows[4][1] and rows[4][0].perplexity < rows[6][0].perplexity
    assert lm.score(empty, lm.train(empty)).collect() == [] == lm.score(empty, lm.train(empty), 0).collect()


def test_sharding(edges, empty):
    rows = by_id(sharding.assign(edges, shards=2).collect())
    assert {k: len(v) for k, v in rows.items()} == {k: 1 for k in range(1, 7)}
    assert sorted(np.bincount([v[0].shard for v in rows.values()], minlength=2).tolist()) == [3, 3]
    assert sharding.assign(empty, shards=2).collect() == []
    assert len(sharding.assign(edges, shards=40).collect()) == 6


VECTORS = [(None, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (50, [0.0, 1.0], 1)]


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    table = spark.createDataFrame(VECTORS, kind).withColumn("id", F.lit("clash")).withColumn("vec", F.lit("clash")).withColumn("cell", F.lit("clash"))
    rows = sorted(map(tuple, covertree.classes(table).collect()))
    assert rows == [(4, 4, 4, 1), (5, 4, 4, 1), (50, 50, 50, 0)]
    near = sorted(map(tuple, neighbours.nearest(table).collect()))
    assert near == [(4, 1, 5, 1.0), (4, 2, 50, 0.0), (5, 1, 4, 1.0), (5, 2, 50, 0.0), (50, 1, 4, 0.0), (50, 2, 5, 0.0)]
    assert sorted(map(tuple, neighbours.nearest(table, every=50).collect())) == near[4:]
    none = spark.createDataFrame([], kind)
    assert covertree.classes(none).collect() == [] == neighbours.nearest(none).collect()


# The pipeline's stages


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(docs given, rows returned) of each stage, in order, written and read as in a run."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        result = spark.read.parquet(str(folder / str(k)))
        out.append((docs, result))
        docs = result
    return out


def test_stages_in_order(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "source mixing", "BPE encoding"]
    columns = stages[0][0].columns
    assert all(out.columns == columns for _, out in stages[:-1])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in stages[-1][1].collect())


def test_language_stage(stages):
    docs, out = stages[0]
    model, rows = langid.train(docs), docs.collect()
    p = langid.classify(model, pa.array([r.text for r in rows], pa.string()))
    keep = []
    for r, q in zip(rows, p, strict=True):
        best = model.labels[int(q.argmax())]
        sure_of_another = r.lang in model.labels and best != r.lang and q.max() >= langid.REJECT_CONFIDENCE
        if q.max() > 0 and not sure_of_another:
            keep.append(r)
    assert sorted(keep, key=str) == sorted(out.collect(), key=str)


def test_toxicity_stage(spark, stages):
    docs, out = stages[1]
    lexicon, rows = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet")), docs.collect()
    scores = [toxicity.Scorer(lexicon).score(pa.array([r.text], pa.string()))[0][0] for r in rows]
    assert sorted((r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD), key=str) == sorted(out.collect(), key=str)


def test_dedup_stage(stages):
    docs, out = stages[2]
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = np.array(sorted(rows))
    prints, words = simhash.fingerprints(pa.array([rows[k] for k in ids], pa.string()))
    near = (simhash.hamming(prints[:, None], prints[None]) <= simhash.RADIUS) & (words[:, None] > 0) & (words > 0)
    near &= np.minimum(words[:, None], words) >= simhash.MIN_LENGTH_RATIO * np.maximum(words[:, None], words)
    label = np.arange(len(ids))
    while True:
        lower = np.minimum(label, np.where(near, label[None], len(ids)).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    assert sorted(ids[label == np.arange(len(ids))].tolist()) == sorted(r.doc_id for r in out.collect())


def test_mixing_stage(stages, tmp_path):
    docs, out = stages[3]
    docs.write.parquet(str(tmp_path / "docs"))
    wanted = duckdb.sql(mixing.oracle_sql(docs=f"'{tmp_path}/docs/*.parquet'")).fetchall()
    assert sorted(r[0] for r in wanted) == sorted(r.doc_id for r in out.collect())


def test_encoding_stage(stages):
    import tiktoken

    sys.path.insert(0, "/opt/tokenizers")
    public = pytest.importorskip("public_tokenizers")
    docs, out = stages[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.tokens for r in out.collect()} == {r.doc_id: own.encode_ordinary(r.text) for r in docs.collect()}


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_edges_and_empty_tables(spark, edges, empty, stage):
    _, run = corpus_pipeline.STAGES[stage]
    out = run(spark, edges, SF)
    kept = sorted((r.doc_id or 0) for r in out.collect())
    assert kept == [[0, 1, 2, 3, 4, 4, 5, 6], [1, 2, 3, 4, 4, 5], [0, 1, 2, 3, 4, 4, 6], kept, [0, 1, 2, 3, 4, 4, 5, 6]][stage]
    if stage < 4:
        assert out.columns == edges.columns
    assert run(spark, empty, SF).collect() == []
