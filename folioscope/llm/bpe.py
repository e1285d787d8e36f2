"""Byte-pair encoding and decoding with a public vocabulary, by traversal of a prefix-sharing trie.

A text is cut into pretokens by the vocabulary's pattern; each distinct pretoken of a batch is inserted into a trie of
bytes, walked depth first. A node stands for a prefix and holds the last token of the prefix's encoding: the one token
that ends there, follows on the last token of the rest, and forms a pair with it that merging would leave alone. This
determines the encoding of every prefix from those of shorter ones (van Antwerpen and Neubeck, 2024), so a prefix that
many words share is encoded once, and a word's tokens are read off by following last tokens back.

Distinct pretokens are found by vectorised hashing; encodings are remembered within a worker, up to a bound. Decoding
joins the tokens' bytes; every encoded row can be checked by an exact round trip.

Defined results: a null text has null tokens and count 0, an empty text no tokens; repeated rows are encoded each; bytes
are those of the text's UTF-8 form, of any length; special tokens don't occur, their strings are ordinary text; extra
columns are kept, and give way where they have the name of a result; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from . import common, textkit

#: Path of the vocabulary: a public file of ranks, token by token in base64.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBER = 200_000
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@cache
def _classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for k in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(k))[0]
        if kind == "L":
            out[k] = LETTER
        elif kind == "N":
            out[k] = NUMBER
    for k in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[k] = SPACE
    return out


def pretoken_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pretokens begin among the code points of several texts; ``first`` has the starts of the texts.

    The pattern: contractions, then runs of letters, of numbers and of other signs, each with one blank before it, then
    white space, of which the last sign is left to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[first[first < n]] = True
    edge[n] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    start = change | edge[:-1]
    space = kind == SPACE
    # The last sign of a run of white space, where the text goes on: a token of its own, or the head of the next one.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    start |= last
    joined = np.flatnonzero(last & (points == 32))
    start[joined + 1] = False
    # Contractions, where an apostrophe begins a token.
    for k in np.flatnonzero((points == 39) & start):
        if k + 1 < n and not edge[k + 1]:
            tail = []
            for j in (k + 1, k + 2):
                if j < n and not edge[j] and not (j == k + 2 and not tail):
                    tail.append(int(points[j]))
            two = "".join(map(chr, tail))
            size = 2 if two[:2] in ("re", "ve", "ll") else 1 if two[:1] in ("s", "t", "m", "d") and two[:1] else 0
            if size:
                start[k + 1] = False
                end = k + 1 + size
                if end < n:
                    start[end] |= not (kind[end] != LETTER and start[end]) and kind[end] == LETTER
                    if space[end]:
                        start[end] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Tokens by rank, with the merges that the ranks imply."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        for token, k in self.rank.items():
            self.bytes[k] = token
        self.longest = max(map(len, self.rank))
        self.pair: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = [(k, k) for k in range(len(self.bytes))]
        for token, k in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1 and (parts := self._parts(token, k)):
                self.split[k] = parts
                self.pair[parts] = k
        self.valid: dict[tuple[int, int], bool] = {}
        #: Tokens as paths of bytes read backwards: their ends are found from a node by walking up.
        self.back: dict = {}
        for token, k in self.rank.items():
            node = self.back
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = k

    def _parts(self, token: bytes, limit: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one: the encoding of its bytes with the lower ranks alone."""
        parts = [self.rank[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(self.bytes[parts[i]] + self.bytes[parts[i + 1]], limit)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [best]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def stays(self, left: int, right: int) -> bool:
        """Whether the encoding of left + right is these two tokens: no merge across the border comes first."""
        known = self.valid.get((left, right))
        if known is not None:
            return known
        a, b, limit, out = left, right, 1 << 62, True
        while True:
            joint = self.pair.get((a, b))
            if joint is not None and joint < limit:
                out = False
                break
            # Undo the later of the two merges that made the tokens at the border.
            if a > b:
                limit = a
                a = self.split[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.split[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit = b + 1
                b = self.split[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.split[a][1]
                    if a == limit:
                        break
        if len(self.valid) > 1_000_000:
            self.valid.clear()
        self.valid[left, right] = out
        return out

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Encodings of distinct words, given in ascending order, so that the trie is walked depth first.

        The stack holds the last tokens of all prefixes of the word at hand; what it shares with the one before is kept.
        """
        out, last, before, back, sizes = [], [-1], b"", self.back, [len(t) for t in self.bytes]
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, at, found = back, end, -1
                while at:
                    node = node.get(word[at - 1])
                    if node is None:
                        break
                    at -= 1
                    token = node.get(-1)
                    if token is not None and (at == 0 or self.stays(last[at], token)):
                        found = token
                        break
                last.append(found)
            tokens, at = [], len(word)
            while at:
                tokens.append(last[at])
                at -= sizes[last[at]]
            out.append(tuple(tokens[::-1]))
            before = word
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts; remembers the encodings of pretokens, within a bound."""

    def __init__(self, vocab: Vocabulary, remember: int = REMEMBER):
        self.vocab, self.remember = vocab, remember
        self.known: dict[int, np.ndarray] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, one text after another, and the texts' offsets in them."""
        tokens, counts = [], []
        for _, part in textkit.chunks(texts):
            t, c = self._chunk(part)
            tokens.append(t)
            counts.append(c)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        return flat, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)

    def _chunk(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = textkit.buffers(part)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(part), np.int64)
        lead = (raw & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.searchsorted(at, offsets[:-1])
        start = at[pretoken_starts(points, first)]
        end = np.append(start[1:], len(raw))
        hashes = textkit.span_hashes(textkit._BYTE[raw], start, end)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = unique.tolist()
        known = self.known
        missing = [k for k, h in enumerate(keys) if h not in known]
        if missing:
            words = sorted((raw[start[where[k]] : end[where[k]]].tobytes(), keys[k]) for k in missing)
            if len(known) > self.remember:
                kept = {h: known[h] for h in keys if h in known}
                known.clear()
                known.update(kept)
            for (_, h), ids in zip(words, self.vocab.encode_words([w for w, _ in words]), strict=True):
                known[h] = np.array(ids, np.int32)
        rows = [known[h] for h in keys]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        table, base = np.concatenate(rows), np.cumsum(size) - size
        each = size[inverse]
        ends = np.cumsum(each)
        place = np.repeat(base[inverse] - (ends - each), each) + np.arange(int(ends[-1]))
        doc = np.searchsorted(offsets, start, "right") - 1
        return table[place], np.bincount(doc, each, len(part)).astype(np.int64)


def decode_flat(vocab: Vocabulary, flat: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of all tokens, and the texts' offsets in them; vectorised over the tokens."""
    sizes = np.fromiter(map(len, vocab.bytes), np.int64, len(vocab.bytes))
    table = np.frombuffer(b"".join(vocab.bytes), np.uint8)
    base = np.cumsum(sizes) - sizes
    each = sizes[flat]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(base[flat] - (ends - each), each) + np.arange(total)
    return table[place].tobytes(), np.concatenate([[0], ends])[offsets]


_RESULTS = {"tokens": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "round_trip": T.BooleanType()}


def encode(docs: DataFrame, path: str = VOCABULARY, keep_text: bool = False) -> DataFrame:
    """docs with tokens, n_tokens and round_trip (whether decoding gives the text back); without text unless kept."""
    others = [c for c in docs.columns if c not in _RESULTS and (keep_text or c != "text")]
    source = docs.select(*others, F.col("text").alias("__text"))
    schema = T.StructType([f for f in source.schema if f.name != "__text"] + [T.StructField(k, v) for k, v in _RESULTS.items()])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        for whole in found:
            for _, rows in _slices(whole):
                texts = rows.column(rows.num_columns - 1).cast(pa.large_string())
                flat, offsets = encoder.encode(texts)
                back, cuts = decode_flat(vocab, flat, offsets)
                raw, own = textkit.buffers(texts.fill_null(""))
                if len(own) and np.array_equal(cuts, own) and raw.tobytes() == back:
                    same = [True] * len(texts)
                else:
                    same = [back[cuts[k] : cuts[k + 1]] == (t or "").encode() for k, t in enumerate(texts.to_pylist())]
                null = texts.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null)
                )
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in range(rows.num_columns - 1)), lists, pa.array(np.diff(offsets)), pa.array(same, pa.bool_())],
                    names=schema.names,
                )

    return source.mapInArrow(common.lean(batches), schema)


def _slices(batch: pa.RecordBatch, limit: int = 1_000_000) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch with about ``limit`` bytes of text, so that a worker's memory is bounded by its longest text."""
    for at, part in textkit.chunks(batch.column(batch.num_columns - 1), limit):
        yield at, batch.slice(at, len(part))


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """rows with the text that their tokens stand for; null tokens give a null text."""
    others = [c for c in rows.columns if c not in ("text", "tokens")]
    source = rows.select(*others, F.col("tokens").alias("__tokens"))
    schema = T.StructType([f for f in source.schema if f.name != "__tokens"] + [T.StructField("text", T.StringType())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in found:
            lists = batch.column(batch.num_columns - 1)
            null = lists.is_null().to_pylist()
            counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            back, cuts = decode_flat(vocab, flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
            texts = [None if gone else back[cuts[k] : cuts[k + 1]].decode("utf-8", "replace") for k, gone in enumerate(null)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(texts, pa.string())], names=schema.names
            )

    return source.mapInArrow(common.lean(batches), schema)
