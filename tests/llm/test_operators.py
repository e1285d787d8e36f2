"""Text operators against public encoders, held-out accuracy and bounds."""

from __future__ import annotations

import numpy as np
import pytest

from folioscope.llm import bpe, langid, licenses, lm, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_equals_the_public_encoder(docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode(docs, keep_text=True).collect()
    assert rows and all(r.round_trip and r.tokens == own.encode_ordinary(r.text) for r in rows)


def test_license_templates_cover_themselves_and_nothing_else():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        assert name in [hit[0] for hit in scanner.scan(f"before {text} after")]
    assert scanner.scan("an ordinary text about software and rivers") == []
    assert licenses.align(list("abcd"), list("axcd")) == [(0, 0), (2, 2), (3, 3)]


def test_bloom_levels_are_never_too_low():
    grams = np.random.default_rng(1).integers(1, 1 << 62, 2000).astype(np.uint64)
    q = np.arange(2000) % 9 + 1
    bloom = lm.Filter(1, np.array([int(q.sum()) * lm.BITS_PER_ENTRY // 64 + 1]))
    bloom.add(grams, q)
    held = bloom.level(grams)
    assert (held >= q).all() and (held == q).mean() > 0.9


def test_language_on_the_rest_of_the_rows(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(docs, langid.train(docs.where("doc_id % 2 = 0"))).where("doc_id % 2 = 1 and confidence > 0").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.85


def test_shards_keep_their_capacity(docs):
    sizes = [r["count"] for r in sharding.assign(docs, shards=4, rounds=2).groupBy("shard").count().collect()]
    n = docs.select("doc_id").distinct().count()
    assert sum(sizes) == n and max(sizes) <= np.ceil(n * 1.05 / 4)
