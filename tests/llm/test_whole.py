"""That operators do the whole job, where an earlier state left a part of it out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import sharding, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def roots(pairs):
    """The least member of each one's component."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def test_near_copies_against_brute_force(spark, docs):
    rows = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    # Besides, a chain of texts with ever more words changed, for many distances up to the radius.
    rng = np.random.default_rng(4)
    for k in range(150):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        other = list(base)
        for at in rng.choice(120, 8 + k // 8, replace=False):
            other[at] = f"x{rng.integers(10**6)}"
        rows[10**7 + 2 * k], rows[10**7 + 2 * k + 1] = " ".join(base), " ".join(other)
    ids = np.array(sorted(rows))
    prints, words = simhash.fingerprints(pa.array([rows[k] for k in ids], pa.string()))
    near = simhash.hamming(prints[:, None], prints[None]) <= simhash.RADIUS
    near &= np.minimum(words[:, None], words) >= simhash.MIN_LENGTH_RATIO * np.maximum(words[:, None], words)
    near &= (words[:, None] > 0) & (words > 0)
    pairs = [(int(ids[i]), int(ids[j])) for i, j in np.argwhere(np.triu(near, 1))]
    wanted = {x: r for x, r in roots(pairs).items() if x != r}
    table = spark.createDataFrame([(int(k), rows[k]) for k in ids], "doc_id long, text string")
    assert len(wanted) > 100
    assert {r.doc_id: r.keep_id for r in simhash.duplicates(table).collect()} == wanted


@pytest.mark.parametrize("parts", [2, 3, 4, 9])
def test_any_differing_bits_leave_a_key_equal(parts):
    rng = np.random.default_rng(parts)
    masks = np.concatenate(simhash.key_masks(parts))
    for _ in range(200):
        bits = np.zeros(simhash.BITS, np.uint8)
        bits[rng.choice(simhash.BITS, simhash.RADIUS, replace=False)] = 1
        assert (~(masks & np.packbits(bits, bitorder="little").view(np.uint64)).any(axis=1)).any()


def test_cells_lose_no_near_pair(spark, docs, monkeypatch):
    some = docs.limit(400).select("doc_id", "text").cache()
    whole = sorted(map(tuple, simhash.duplicates(some).collect()))
    monkeypatch.setattr(simhash, "CELL", 100)
    assert whole and sorted(map(tuple, simhash.duplicates(some).collect())) == whole


def test_shared_runs_within_lines_link(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, wanted = [], set()
    for k in range(40):
        run, copy = word(12), word(60)
        rows += [(4 * k, " ".join(word(k) + run + word(9))), (4 * k + 1, " ".join(word(5) + run + word(2 * k)))]
        near = [f"x{k}" if at % 15 == 7 else x for at, x in enumerate(copy)]
        rows += [(4 * k + 2, " ".join(copy)), (4 * k + 3, " ".join(near))]
        wanted |= {(4 * k, 4 * k + 1), (4 * k + 2, 4 * k + 3)}
    rows += [(1000, "the very same line of four"), (1001, "no word\nAbcdefghijklmnop qrstuvwxyzabcdef"), (1002, "abcdefghijklmnop qrstuvwxyzabcdef ")]
    wanted.add((1001, 1002))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    held = {}
    for r in sharding.links(table).collect():
        held.setdefault(r.passage, set()).add(r.doc_id)
    assert {tuple(sorted(x)) for x in held.values()} == wanted
    shard = {r.doc_id: r.shard for r in sharding.assign(table, shards=4).collect()}
    assert sum(shard[a] == shard[b] for a, b in wanted) >= 0.95 * len(wanted)


def test_one_misspelled_term_is_enough(spark):
    rows = [(1, "you are an idiott"), (2, "you are an 1d10t"), (3, "you are an idiooot"), (4, "you are an idiom"), (5, 'the word "idiott" is misspelled')]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.Lexicon(list(toxicity.SEEDS))
    assert sorted(r.doc_id for r in toxicity.score(table, lexicon).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in toxicity.reject(table, lexicon).collect()) == [4, 5]


def test_errors_in_first_letters_and_in_stems():
    lexicon = toxicity.Lexicon(["idiot", "stupid", "dummkopf*"])
    for word, term in [("jdiot", "idiot"), ("xstupid", "stupid"), ("diiot", "idiot"), ("diot", "idiot"), ("sstupid", "stupid"), ("sutpid", "stupid")]:
        assert lexicon.match(word) == (term, 1)
    for word in ("dumkopfes", "bummkopf", "udmmkopfen", "dummkipfhaft"):
        assert lexicon.match(word) == ("dummkopf*", 1)
    assert [lexicon.match(w) for w in ("rapid", "idol", "dumm", "kopf", "dummheit")] == [None] * 5
    assert toxicity.Lexicon(["dummkopf*"], {"dummkip*", "dumkopfes"}).match("dumkopfes") is None
    assert toxicity.Lexicon(["dummkopf*"], {"dummkip*"}).match("dummkipfhaft") is None
