"""Operators against brute-force versions of themselves on small tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import bpe, covertree, langid, licenses, lm, neighbours, sharding, textkit, toxicity, vectors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Embedding near-dedup


def near_and_groups(x, cosine):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        lower = np.minimum(label, np.where(near, label[None], len(x)).min(axis=1))
        if (lower == label).all():
            return near.sum(axis=1), label
        label = lower


@pytest.mark.parametrize("options", [{}, {"cell": 60}, {"cell": 200, "block": 64}, {"cell": 10, "most": 5, "block": 100}])
def test_classes_of_vectors(spark, options):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    x = base[rng.integers(0, 30, 700)] + rng.normal(scale=0.12, size=(700, 8))
    x[:200] = base[0] + rng.normal(scale=0.01, size=(200, 8))
    x[200:300] = base[1]
    x[300:350] = base[2] + rng.normal(scale=0.0001, size=(50, 8))
    x = x[rng.permutation(700)]
    links, groups = near_and_groups(x, 0.95)
    table = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in covertree.classes(table, **options).collect()}
    first = {}
    for k, r in enumerate(x):
        first.setdefault(r.tobytes(), k)
    assert links.sum() > 10_000 and len(set(groups)) > 20
    assert [rows[k].links for k in range(700)] == links.tolist()
    assert [rows[k].group_id for k in range(700)] == groups.tolist()
    assert [rows[k].class_id for k in range(700)] == [first[r.tobytes()] for r in x]


# Nearest neighbours


def test_descent_from_small_cells(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    points = neighbours._points(table, "vec_id", "embedding")
    data = table.toPandas()
    x = vectors.matrix(data["embedding"].to_numpy())
    ids = data["vec_id"].to_numpy()
    cosine = x @ x.T
    np.fill_diagonal(cosine, -9)
    kth = dict(zip(ids, np.sort(cosine, axis=1)[:, -10], strict=True))

    def recall(rows):
        return sum(r.cosine >= kth[r.vec_id] - 2e-4 for r in rows) / sum(1 for k in kth if k in {r.vec_id for r in rows}) / 10

    before = neighbours.descend(points, rounds=0, cell=32)
    assert recall(neighbours._report(before, points, points, 10).collect()) < 0.5
    found = neighbours.nearest(table, every=50, cell=32).collect()
    assert {r.vec_id for r in found} == {int(k) for k in ids if k % 50 == 0}
    assert recall(found) >= 0.9


def test_lookup_of_other_vectors(spark):
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(600, 6)), rng.normal(size=(25, 6))
    frame = lambda rows, base: spark.createDataFrame([(base + k, [float(v) for v in r]) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    found = neighbours.lookup(frame(x, 0), frame(q, 10_000), k=5).collect()
    cosine = vectors.matrix(q) @ vectors.matrix(x).T
    kth = np.sort(cosine, axis=1)[:, -5]
    assert len(found) == 125
    assert sum(r.cosine >= kth[r.vec_id - 10_000] - 2e-4 for r in found) / 125 >= 0.9


# License scan


def spread(text, filler, every=1):
    return " ".join(w + (f" {filler}{k}" if k % every == 0 else "") for k, w in enumerate(text.split()))


def test_texts_whose_whole_alignment_covers_a_template_are_found():
    rng, scanner = random.Random(3), licenses.Scanner()
    names = sorted(licenses.TEMPLATES)
    for k in range(60):
        name = names[k % len(names)]
        words = licenses.TEMPLATES[name].split()
        kept = [w for w in words if rng.random() > 0.08]
        mixed = [y for w in kept for y in ([w] + [f"q{rng.randrange(10**6)}" for _ in range(rng.choice((0, 0, 1, 2, k % 7)))])]
        text = " ".join([f"z{j}" for j in range(k)] + mixed + ["end"] * (k % 3))
        tokens = licenses.words(text)
        hits = {h[0]: h for h in scanner.scan(text)}
        for other, template in scanner.templates.items():
            aligned = len(licenses.align(tokens, template))
            if aligned >= licenses.COVERAGE * len(template):
                # Found itself, or given way to one that aligns with more of the same words.
                assert other in hits and hits[other][2] >= aligned or any(h[2] >= aligned for h in hits.values())
        if len(licenses.align(tokens, scanner.templates[name])) >= licenses.COVERAGE * len(scanner.templates[name]):
            assert hits


def test_fillers_and_repetitions():
    scanner = licenses.Scanner()
    assert scanner.scan(spread(licenses.TEMPLATES["MIT"], "x"))[0][:1] == ("MIT",)
    assert scanner.scan(spread(licenses.TEMPLATES["ISC"], "one two three four x"))[0][:1] == ("ISC",)
    twice = licenses.TEMPLATES["MIT"] + " and so on " * 40 + licenses.TEMPLATES["MIT"]
    assert [(h[0], h[3]) for h in scanner.scan(twice)] == [("MIT", 2)]


# Language model


def reference_scores(rows):
    """Scores from exact counts, quantised like those of the filter, one document at a time."""
    texts = {k: [w for w in _words(t)] for k, t in rows}
    uni = Counter(w for t in texts.values() for w in t)
    pairs = Counter(p for t in texts.values() for p in zip(t, t[1:], strict=False))
    total, types, out = sum(uni.values()), len(uni), {}
    count = lambda n: float(lm.expected(lm.levels(np.array([n])))[0]) if n else 0.0
    for k, t in texts.items():
        own, own_pairs, log = Counter(t), Counter(zip(t, t[1:], strict=False)), 0.0
        for at, w in enumerate(t):
            one = (max(count(uni[w]) - own[w], 0) + 1) / (total - len(t) + types + 1)
            h = max(count(uni[t[at - 1]]) - own[t[at - 1]], 0) if at else 0
            two = min(1, max(count(pairs[t[at - 1], w]) - own_pairs[t[at - 1], w], 0) / h) if h else 0
            share = h / (h + lm.MU)
            log += math.log(share * two + (1 - share) * one)
        out[k] = (len(t), log)
    return out


def _words(text):
    w = textkit.words(pa.array([text or ""], pa.large_string()))
    return [w.text(k) for k in range(len(w.hash))]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_scores_against_exact_counts(docs, limit):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    wanted = reference_scores([(r.doc_id, r.text) for r in some.collect()])
    # With room for every entry, false positives are next to none.
    roomy = {r.doc_id: r for r in lm.score(some, lm.train(some, segment_text=100_000, bits_per_entry=200), limit).collect()}
    usual = {r.doc_id: r for r in lm.score(some, lm.train(some, segment_text=100_000), limit).collect()}
    assert roomy.keys() == usual.keys() == wanted.keys()
    assert all(roomy[k].n_words == usual[k].n_words == n for k, (n, _) in wanted.items())
    assert sum(abs(roomy[k].log_prob - log) > 1e-4 * max(1, n) for k, (n, log) in wanted.items()) <= len(wanted) // 50
    rest = [abs(usual[k].log_prob - log) / n for k, (n, log) in wanted.items() if n]
    assert np.mean(rest) < 0.25


def test_both_plans_give_the_very_same_scores(docs):
    model = lm.train(docs, segment_text=50_000)
    assert model.segments > 3
    one, two = (sorted(map(str, lm.score(docs, model, limit).collect())) for limit in (1 << 30, 0))
    assert one == two and len(one) == docs.count()


def test_copies_score_apart(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    texts = [word(120) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k]) for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.perplexity for r in lm.score(table, lm.train(table)).collect()}
    assert max(found[k] for k in range(20)) < min(found[k] for k in range(20, 120))


def test_blocks_of_hashes_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        grams = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        counts = rng.choice([1, 2, 254, 255, 256, 10**9], len(grams))
        assert (lm.unpack_sorted(lm.pack_sorted(grams)) == grams).all()
        assert (lm.unpack_counts(lm.pack_counts(counts), len(grams)) == counts).all()


# Language identification


def test_network_against_loops():
    rng = np.random.default_rng(2)
    model = langid.ByteCnn(["a", "b", "c"])
    model.start()
    texts = ["", "Straße und Füße", "x" * 5, "the quick brown fox " * 40, "123 456"]
    found = langid.classify(model, pa.array(texts, pa.string()))
    w, wide = model.weights, max(langid.WIDTHS)
    for text, got in zip(texts, found, strict=True):
        raw, total, weights = text.lower().encode(), np.zeros(3), 0
        n = -(-len(raw) // langid.WINDOW)
        for k in range(n):
            start = max(0, min(k * langid.WINDOW, len(raw) - langid.WINDOW))
            part = raw[start : start + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            if not any(c >= 128 or 97 <= c <= 122 for c in part):
                continue
            pooled = np.full(w["kernel"].shape[1], -np.inf)
            for at in range(langid.WINDOW - wide + 1):
                pooled = np.maximum(pooled, np.concatenate([w["embed"][c] for c in part[at : at + wide]]) @ w["kernel"])
            z = np.maximum(pooled + w["shift"], 0) @ w["head"] + w["bias"]
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            held = min(langid.WINDOW, len(raw) - k * langid.WINDOW)
            total, weights = total + p * held, weights + held
        assert np.allclose(got, total / max(weights, 1), atol=1e-4)
    assert rng is not None


def test_rare_languages_are_learnt(spark):
    rng = np.random.default_rng(3)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(60))
    rows = [(k, text("abcdefgh"), "aa") for k in range(4000)] + [(5000 + k, text("uvwxyz"), "zz") for k in range(16)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, rows=600)
    assert model.labels == ["aa", "zz"]
    found = langid.identify(table.where("doc_id >= 3990"), model).collect()
    assert all(r.lang == r.lang_pred for r in found)


# Toxicity


def distance(a, b):
    """Insertions, deletions, substitutions and exchanges of neighbours, no letter edited twice."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d


def test_automaton_and_screen_against_distances():
    rng = random.Random(4)
    terms = ["idiot", "scum", "worthless", "disgusting", "dummkopf*", "réeux*", "trash"]
    lexicon = toxicity.Lexicon(terms)
    letters, words = "abdefghiklmnoprstuwé", set()
    for _ in range(1500):
        word = list(rng.choice(terms).rstrip("*"))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                word.insert(at, rng.choice(letters))
            elif kind == 1 and word:
                word.pop(min(at, len(word) - 1))
            elif kind == 2:
                word[min(at, len(word) - 1) :][:1] = [rng.choice(letters)]
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
        words.add("".join(word))
    words = sorted(w for w in words if len(w) >= 4 and w not in toxicity.LOOKALIKES and not any(w[k] == w[k + 1] == w[k + 2] for k in range(len(w) - 2)))
    screened = {w for w, _ in lexicon._likely(words, lexicon.allowed)}
    matched = 0
    for word in words:
        near = []
        for term in terms:
            stem = term.rstrip("*")
            d = distance(word, stem)
            errors = int(d[:, -1].min() if term.endswith("*") else d[-1, -1])
            if errors <= toxicity.allowed_errors(stem):
                near.append((errors, term))
        found = lexicon.match(word)
        wanted = min(near)[0] if near else None
        assert (found[1] if found else None) == wanted, (word, found, near)
        assert not found or word in screened
        matched += bool(found)
    assert 300 < matched < len(words)


def test_learning_needs_evidence_at_any_size(spark):
    def table(toxic, clean):
        rng = np.random.default_rng(9)
        word = lambda n: [f"wort{chr(97 + x // 26)}{chr(97 + x % 26)}" for x in rng.integers(0, 300, n)]
        rows = [(k, " ".join([*word(8), "grobian", *word(8)]), 1) for k in range(toxic)]
        rows += [(10_000 + k, " ".join(word(60)), 0) for k in range(clean)]
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
        return toxicity.learn(docs, labels)

    assert any(t.startswith("grob") for t in table(30, 60).terms)
    assert not any(t.startswith("grob") for t in table(30, 3).terms)


def test_misspellings_must_be_nearer_to_a_learnt_term_than_to_clean_words():
    plain = toxicity.Lexicon(["grobian"], {"garten"}, {"grobian"})
    assert plain.match("grobiam") == ("grobian", 1) and plain.match("grobain") == ("grobian", 1)
    crowded = toxicity.Lexicon(["grobian"], {"grabiam"}, {"grobian"})
    assert crowded.match("grobian") == ("grobian", 0) and crowded.match("grobiam") is None


def test_words_that_docstrings_promise():
    lexicon = toxicity.Lexicon(list(toxicity.SEEDS))
    for word, term in [("worhles", "worthless"), ("xdiot", "idiot"), ("ldiot", "idiot"), ("diot", "idiot"), ("w0rthless", "worthless")]:
        assert lexicon.match(word)[0] == term


# Sharding


def test_cut_is_counted_right_and_lowered(spark, docs):
    edges = sharding.links(docs).cache()
    held: dict[int, list] = {}
    for r in edges.collect():
        held.setdefault(r.passage, []).append(r)
    start = {r.doc_id: r.shard for r in sharding.assign(docs, shards=4, rounds=0).collect()}
    end = {r.doc_id: r.shard for r in sharding.assign(docs, shards=4).collect()}

    def cut(shard):
        out = 0.0
        for rows in held.values():
            apart = sum(shard[a.doc_id] != shard[b.doc_id] for k, a in enumerate(rows) for b in rows[:k])
            out += rows[0].weight * apart / (rows[0].size - 1)
        return out

    for shard in (start, end):
        table = spark.createDataFrame(list(shard.items()), "doc_id long, shard int")
        assert abs(sharding.cut(edges, table)[0] - cut(shard)) < 1e-6
    assert cut(end) < cut(start)


def test_salts_change_nothing(docs, monkeypatch):
    edges = sharding.links(docs).cache()
    labels = sharding.assign(docs, shards=4, rounds=0).cache()
    wanted = {(r.doc_id, r.to): r.gain for r in sharding.wishes(edges, labels).collect()}
    monkeypatch.setattr(sharding, "HOT", 2)
    salted = {(r.doc_id, r.to): r.gain for r in sharding.wishes(edges, labels).collect()}
    assert wanted and wanted.keys() == salted.keys() and all(abs(wanted[k] - salted[k]) < 1e-9 for k in wanted)


# BPE


def test_decoding_gives_the_texts_back(spark, docs):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "naïve  \n\n x🙂​"), (-4, "ab " * 40_000)], "doc_id long, text string")
    whole = docs.select("doc_id", "text").union(odd)
    encoded = bpe.encode(whole)
    back = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    assert back == {r.doc_id: r.text for r in whole.collect()}
