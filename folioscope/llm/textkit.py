"""Vectorised word spans, hashes and gathers over Arrow string arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 400_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, each output bit depending on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_WORD = np.zeros(256, bool)
for _c in range(256):
    _WORD[_c] = _c >= 128 or chr(_c).isalnum()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier and its inverse modulo 2**64, to the powers below n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES * 3)
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            row = np.full(size, base & _MASK, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], from one running sum: equal content has equal hashes at any place."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``limit`` bytes each; a longer text is one chunk. Nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        base = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and the offsets of its texts in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts: text number, place in the bytes, and hash; starts of the texts in the words."""

    raw: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def text(self, k: int) -> str:
        return self.raw[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")


def words(texts: pa.Array) -> Words:
    """Lower-case runs of letters and digits. General punctuation and Latin-1 signs outside ASCII separate too."""
    lower = pc.utf8_lower(texts)
    raw, offsets = buffers(lower)
    inside = _WORD[raw]
    if len(raw) > 2:
        for k in np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80)):
            inside[k : k + 3] = False
        for k in np.flatnonzero(raw[:-1] == 0xC2):
            inside[k : k + 2] = False
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    padded = np.zeros(len(raw) + 2, bool)
    padded[1:-1] = inside
    start = np.flatnonzero(inside & (~padded[:-2] | edge[:-1]))
    end = np.flatnonzero(inside & (~padded[2:] | edge[1:])) + 1
    return Words(
        raw,
        np.searchsorted(offsets, start, "right") - 1,
        start,
        end,
        span_hashes(_BYTE[raw], start, end),
        np.searchsorted(start, offsets),
    )
