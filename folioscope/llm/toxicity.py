"""Toxicity: misspelled lexicon terms by automata, and context windows that tell quotation from abuse.

A lexicon holds whole terms and stems (a stem matches every word that it begins). Each distinct word of a text is read
as a Levenshtein automaton, simulated by one bit mask per number of errors, and intersected with the trie of the
lexicon: a branch is left as soon as no state is alive, so a word costs a few trie nodes. A misspelled term weighs as
much as the term itself and reaches the threshold alone; clean words near a term are spared by a list (LOOKALIKES and
the words of clean labelled texts), not by weight. Words whose letters or length rule out every term aren't read at all.
A hit then gets the weight of its window: quotation marks around it, or a reporting verb shortly before, mark a mention
rather than an insult.

Terms beyond the given ones are learnt from labelled rows: words and stems that stand in many different contexts of
toxic texts and in no clean one.

Defined results: null and empty texts have no hit and score 0; texts are read whole, of any length; rows with a null
doc_id are scored too; repeated rows are scored each; ties between terms go to the fewest errors, then to the term that
sorts first; extra columns, of any names, are ignored (``score``) or kept (``reject``); an empty table gives an empty
result; without toxic or without clean labels the given lexicon is used alone.
"""

from __future__ import annotations

import math
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, textkit

SEEDS = ("loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid")
#: Bounds of the labelled rows that terms are learnt from; every document is then scored.
LEARN_TOXIC, LEARN_CLEAN = 2000, 6000
MIN_CONTEXTS, CHANCE = 12, 1e-4
WINDOW = 6
THRESHOLD = 1.0
EXACT, FUZZY, QUOTED = 1.0, 1.0, 0.2
REPORTING = frozenset(
    "said says quoted quote wrote called calls term word phrase named dit dijo sagte zitat cita citation palabra mot wort".split()
)
_LEET = str.maketrans("013457", "oieast")
_RUNS = re.compile(r"(.)\1\1+")
_OPEN, _CLOSE = '"“«„‘‚', '"”»“’'


#: Everyday words one error away from a given term.
LOOKALIKES = frozenset((
        "lose loses loosen lower lover laser loner poser closer crown brown blown flown moon moons mormon boron moran maron crash brash thrash scam slum "
        "losen loper hoser doser oser leser gloser morn rash apathetic idiom discussing digesting disrupting mirthless worthies worthiness"
    ).split()
)


def allowed_errors(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


def _letters(raw: np.ndarray) -> np.ndarray:
    """A bit for each byte that is a letter from a to z."""
    return _LETTER[raw]


_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.uint32(1) << np.arange(26, dtype=np.uint32)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Screen:
    """Which words can be near a term at all, by their letters and lengths; none that the automaton matches is lost.

    An error changes the set of letters by one each way, and the length by one.
    """

    def __init__(self, allowed: dict[str, int]):
        names = sorted(allowed)
        self.sets = np.array([np.bitwise_or.reduce(_letters(np.frombuffer(t.encode(), np.uint8))) for t in names], np.uint32)
        self.sizes = np.array([len(t.rstrip("*")) for t in names], np.int64)
        self.errors = np.array([allowed[t] for t in names], np.int64)
        self.stems = np.array([t.endswith("*") for t in names], bool)

    def errors_of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word, given in ascending order, the most errors that a term may need; -1 where no term is near."""
        if not len(start) or not len(self.sets):
            return np.full(len(start), -1)
        at = np.stack([start, end], axis=1).ravel()
        pad = np.append(raw, np.uint8(0))
        held = np.bitwise_or.reduceat(_letters(pad), at)[::2]
        run = np.zeros(len(pad), bool)
        run[:-3] = (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:])
        # Digits that may stand for letters, and letters that repeat, are put right only by the match itself.
        odd = (np.logical_or.reduceat(_DIGIT[pad], at)[::2] & (held > 0)) | np.logical_or.reduceat(run, at)[::2]
        size = np.add.reduceat(((pad & 0xC0) != 0x80).astype(np.int64), at)[::2]
        out = np.full(len(start), -1)
        for letters, length, errors, stem in zip(self.sets, self.sizes, self.errors, self.stems, strict=True):
            near = (np.bitwise_count(letters & ~held) <= errors) & (size >= length - errors)
            if not stem:
                near &= (np.bitwise_count(held & ~letters) <= errors) & (size <= length + errors)
            out[near & (out < errors)] = errors
        out[odd] = self.errors.max()
        return out


class Lexicon:
    """A trie of terms; ``*`` at the end of a term makes it a stem.

    ``learnt`` terms are matched with one error at most, and exactly only where a word of clean text is within two
    errors: a misspelling must be nearer to the term than to any clean word.
    """

    def __init__(self, terms: list[str], clean: set[str] | frozenset[str] = frozenset(), learnt: set[str] | frozenset[str] = frozenset()):
        self.terms = sorted(set(terms))
        self.spared: frozenset[str] = LOOKALIKES
        self.root: dict = {}
        for term in self.terms:
            node = self.root
            for c in term.rstrip("*"):
                node = node.setdefault(c, {})
            node["*" if term.endswith("*") else ""] = term
        self.begins = frozenset(w[:-1] for w in clean if w.endswith("*"))
        whole = sorted(w for w in clean if not w.endswith("*"))
        self.allowed = {t: allowed_errors(t.rstrip("*")) for t in self.terms}
        wide = {t: 2 if len(t.rstrip("*")) >= 5 else 0 for t in learnt}
        crowded = {near for w, k in self._likely(whole, wide) if k > 0 for near in self._near(w, wide)}
        self.allowed |= {t: 0 if t in crowded else min(1, self.allowed[t]) for t in learnt}
        self.spared |= {w for w, _ in self._likely(whole, self.allowed) if (m := self.match(w)) and m[1]}
        self.screen = Screen(self.allowed)

    @staticmethod
    def _likely(words: list[str], allowed: dict[str, int]) -> Iterator[tuple[str, int]]:
        """(word, errors) of the words that may be near one of the terms."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) + 1 for w in raw])
        starts = ends - np.array([len(w) + 1 for w in raw], np.int64)
        flat = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        for w, k in zip(words, Screen(allowed).errors_of(flat, starts, ends - 1).tolist() if words else [], strict=True):
            if k >= 0:
                yield w, k

    def _near(self, word: str, allowed: dict[str, int]) -> set[str]:
        """The terms within their allowed errors of word, itself apart."""
        found: dict[str, int] = {}
        self._automaton(word, 2, allowed, found)
        return set(found)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, errors) of the best term for word, or None.

        One error (insertion, deletion, substitution, two letters exchanged) is allowed in terms of five letters and
        more, two in given terms of nine and more, in any letter, and none in words known from clean text; digits that
        stand for letters and letters repeated three times or more are put right beforehand, at no cost but counted as
        an error. A misspelled stem matches where some beginning of the word is near enough to it, but not in words
        that begin as words of clean text do.
        """
        plain = word
        if len(word) >= 4:
            if not word.isalpha() and not word.isdigit():
                plain = word.translate(_LEET)
            plain = _RUNS.sub(r"\1", plain)
        found = self._walk(plain)
        if found and plain != word and not found[1]:
            return found[0], 1
        return found

    def _walk(self, word: str) -> tuple[str, int] | None:
        node: dict | None = self.root
        for c in word:
            if "*" in node:
                return node["*"], 0
            node = node.get(c)
            if node is None:
                break
        if node is not None:
            if "*" in node:
                return node["*"], 0
            if "" in node:
                return node[""], 0
        # A term of nine letters may have lost two, one of five letters one.
        errors = 2 if len(word) >= 7 else 1 if len(word) >= 4 else 0
        if not errors or word in self.spared:
            return None
        found: dict[str, int] = {}
        self._automaton(word, errors, self.allowed, found)
        best = min(((k, t) for t, k in found.items() if not (t.endswith("*") and word[: min(len(t) - 1, 7)] in self.begins)), default=None)
        return (best[1], best[0]) if best else None

    def _automaton(self, word: str, errors: int, allowed: dict[str, int], found: dict[str, int]) -> None:
        """Put the terms within their allowed errors of word into found, with their errors."""
        masks: dict[str, int] = defaultdict(int)
        for k, c in enumerate(word):
            masks[c] |= 1 << k
        final = 1 << len(word)
        none = [0] * (errors + 1)
        # A node, its states, those of its parent, and where its own letter stands in the word.
        stack = [(self.root, [(1 << (k + 1)) - 1 for k in range(errors + 1)], none, 0)]
        while stack:
            node, states, parent, last = stack.pop()
            for c, child in node.items():
                if c == "*" or c == "":
                    for k, state in enumerate(states):
                        if state if c else state & final:
                            if k <= allowed.get(child, -1):
                                found[child] = k
                            break
                    continue
                hit = masks.get(c, 0)
                row = [(states[0] & hit) << 1]
                alive = row[0]
                for k in range(1, errors + 1):
                    before = states[k - 1]
                    now = ((states[k] & hit) << 1) | before | ((before | row[k - 1]) << 1) | ((parent[k - 1] & hit & (last >> 1)) << 2)
                    row.append(now)
                    alive |= now
                if alive:
                    stack.append((child, row, states, hit))


def _contexts(texts: list[str]) -> tuple[dict[str, set], dict[str, int]]:
    """Of words and stems (4 to 7 letters), the different (word before, word after) pairs around, and the texts."""
    out: dict[str, set] = defaultdict(set)
    count: dict[str, int] = defaultdict(int)
    for text in texts:
        found = ["", *re.findall(r"[^\W\d_]+", text.lower()), ""]
        own = set()
        for k in range(1, len(found) - 1):
            word = found[k]
            if len(word) >= 4:
                around = hash((found[k - 1], found[k + 1]))
                for term in (word, *(word[:n] + "*" for n in range(4, min(8, len(word))))):
                    out[term].add(around)
                    own.add(term)
        for term in own:
            count[term] += 1
    return out, count


def learn(docs: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = SEEDS) -> Lexicon:
    """The given terms and those that labelled rows add, from at most LEARN_TOXIC and LEARN_CLEAN rows.

    A term counts by the different contexts around it, so that copies of a toxic text, or a passage that several
    share, add one context and not many. It must also stand in so many toxic texts that, if it had nothing to do with
    toxicity, a chance below ``CHANCE`` would have kept it out of all clean ones: with few clean rows it takes more
    toxic ones. A stem replaces the longer terms that it covers.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = []
    for kind, rows in ((1, LEARN_TOXIC), (0, LEARN_CLEAN)):
        picks = common.bounded_sample(marked.where(F.col("toxic") == kind), "doc_id", rows, 5)
        chosen += [(int(r.doc_id), kind) for r in picks.select("doc_id").collect()]
    if not chosen:
        return Lexicon(list(seeds))
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    sample = docs.where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").select("text", "toxic").toPandas()
    bad = sample.loc[sample["toxic"] == 1, "text"].drop_duplicates()
    toxic, texts = _contexts(list(bad))
    clean = sample.loc[sample["toxic"] == 0, "text"].drop_duplicates()
    known: set[str] = set()
    for text in clean:
        for word in set(re.findall(r"[^\W\d_]+", text.lower())):
            known.add(word)
            known.update(word[:n] + "*" for n in range(4, min(8, len(word))))
    share = (len(bad) + 1) / (len(bad) + len(clean) + 1)
    least = math.log(CHANCE) / math.log(share) if share < 1 else math.inf
    held: list[str] = []
    plain = set(seeds)
    firm = (t for t, around in toxic.items() if len(around) >= MIN_CONTEXTS and texts[t] >= least and t not in known)
    for term in sorted(firm, key=lambda t: (len(t.rstrip("*")), t)):
        word = term.rstrip("*")
        if any(s.startswith(word) for s in plain) or any(word.startswith(h) for h in held):
            continue
        completions = {w for w in toxic if w.startswith(word) and not w.endswith("*")} if term.endswith("*") else ()
        if term.endswith("*") and len(completions) < 5:
            continue
        if term.endswith("*"):
            term = os.path.commonprefix(sorted(completions)) + "*"
            held.append(word)
        plain.add(term)
    return Lexicon(sorted(plain), known, plain - set(seeds))


class Scorer:
    """Scores batches of texts; remembers the terms of words, within a bound."""

    def __init__(self, lexicon: Lexicon, remember: int = 500_000):
        self.lexicon, self.remember = lexicon, remember
        self.known: set[int] = set()
        self.hits: dict[int, tuple[str, int]] = {}

    def _terms(self, w: textkit.Words) -> dict[int, tuple[str, int]]:
        """Word number -> (term, errors), for the words that match."""
        if not len(w.hash):
            return {}
        unique, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        hashes = unique.tolist()
        new = first[[h not in self.known for h in hashes]]
        new.sort()
        near = self.lexicon.screen.errors_of(w.raw, w.start[new], w.end[new])
        for k in new[near >= 0].tolist():
            if found := self.lexicon.match(w.text(k)):
                self.hits[int(w.hash[k])] = found
        if len(self.known) > self.remember:
            self.known.clear()
        self.known.update(hashes)
        if not self.hits:
            return {}
        marks = np.isin(unique, np.fromiter(self.hits, np.uint64, len(self.hits)))
        return {int(k): self.hits[int(w.hash[k])] for k in np.flatnonzero(marks[inverse])}

    def score(self, texts: pa.Array) -> list[tuple[float, int, list[str]]]:
        """(score, hits, distinct terms) of each text."""
        out: list = []
        for _, part in textkit.chunks(texts, 1_500_000):
            w = textkit.words(part)
            scores, count = [0.0] * len(part), [0] * len(part)
            terms: list[set] = [set() for _ in range(len(part))]
            for k, (term, errors) in self._terms(w).items():
                doc = int(w.doc[k])
                weight = FUZZY if errors else EXACT
                if self._mentioned(w, k, doc):
                    weight *= QUOTED
                scores[doc] += weight
                count[doc] += 1
                terms[doc].add(term)
            out += [(round(s, 6), n, sorted(t)) for s, n, t in zip(scores, count, terms, strict=True)]
        return out

    def _mentioned(self, w: textkit.Words, k: int, doc: int) -> bool:
        """Whether word k stands in a quotation within its window, or soon after a reporting verb."""
        low, high = max(k - WINDOW, w.bounds[doc]), min(k + WINDOW, w.bounds[doc + 1] - 1)
        before = w.raw[w.start[low] : w.start[k]].tobytes().decode("utf-8", "replace")
        if k == low or w.start[low] == w.start[w.bounds[doc]]:
            before = w.raw[max(0, w.start[low] - 3) : w.start[low]].tobytes().decode("utf-8", "ignore")[-1:] + before
        after = w.raw[w.end[k] : w.end[high] + 3].tobytes().decode("utf-8", "ignore")
        opened = max(before.rfind(c) for c in _OPEN)
        straight = before.count('"') % 2 == 1 if opened >= 0 and before[opened] == '"' else True
        if opened >= 0 and straight and not any(c in before[opened + 1 :] for c in "”»’") and any(c in after for c in _CLOSE):
            return True
        return any(w.text(j) in REPORTING for j in range(max(low, k - 3), k))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, hits, terms) of the rows that reach the threshold."""
    schema = "doc_id long, score double, hits int, terms array<string>"

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in found:
            rows = scorer.score(batch.column("text"))
            keep = [k for k, r in enumerate(rows) if r[0] >= threshold]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(keep, pa.int64())),
                    pa.array([rows[k][0] for k in keep], pa.float64()),
                    pa.array([rows[k][1] for k in keep], pa.int32()),
                    pa.array([rows[k][2] for k in keep], pa.list_(pa.string())),
                ],
                names=["doc_id", "score", "hits", "terms"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(batches), schema)


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that reach the threshold, all columns kept, in one pass over the text."""
    schema = docs.schema

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in found:
            rows = scorer.score(batch.column(schema.names.index("text")))
            yield batch.filter(pa.array([r[0] < threshold for r in rows], pa.bool_()))

    return docs.mapInArrow(common.lean(batches), schema)
