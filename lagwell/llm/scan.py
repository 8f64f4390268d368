"""Vectorised byte scans over Arrow string batches: words, hashes and n-grams without a Python loop per word.

A text is taken as UTF-8 bytes with A-Z lowered. Word and n-gram hashes are 64-bit polynomial sums over random byte
weights, finished by an integer mixer; they depend on the bytes alone, so any task, batch or run gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64
#: Odd multiplier of the polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_WEIGHTS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)

#: Byte classes: True for bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing mixer of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        p, q = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        p[0] = q[0] = 1
        _powers, _inverses = np.multiply.accumulate(p), np.multiply.accumulate(q)


def chunks(texts: pa.Array, limit: int = 1 << 20, rows: int = 20_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of about `limit` bytes and at most `rows` rows; a single longer text is a piece of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit or i - begin == rows:
            yield begin, texts.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(texts):
        yield begin, texts.slice(begin)


def flat(texts: pa.Array, table: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, mapped by table (A-Z lowered), one space (0x20) after each text, and begin offsets (n + 1)."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    begins = offsets - offsets[0]
    out = np.insert(table[data], begins[1:], 0x20)
    return out, begins + np.arange(n + 1)


AS_IS = np.arange(256, dtype=np.uint8)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of data."""
    _grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WEIGHTS[data] * _powers[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * _inverses[begin])


class Words:
    """Words of a piece: `hash` per word, `text` (row in the piece) per word, `first` (first word of each row, n + 1)."""

    def __init__(self, texts: pa.Array, parts: np.ndarray = SPACE):
        data, begins = flat(texts)
        self.rows = len(begins) - 1
        inside = ~parts[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.data, self.begins = data, begins
        self.hash = span_hashes(data, self.begin, self.end)
        self.first = np.searchsorted(self.begin, begins)
        self.text = np.repeat(np.arange(self.rows), np.diff(self.first))


def ngrams(words: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n words in a row of one text; short=True adds the whole sequence of texts with 1 to n - 1."""
    h, first = words.hash, words.first
    count = np.diff(first)
    if len(h) >= n:
        g = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            g = mix(g * _U(BASE) + h[j : len(h) - n + 1 + j])
        row = words.text[: len(g)]
        keep = words.text[n - 1 :] == row
        row, g = row[keep], g[keep]
    else:
        row, g = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if short and len(few := np.flatnonzero((count > 0) & (count < n))):
        extra = np.zeros(len(few), np.uint64)
        for i, r in enumerate(few):
            x = np.array([count[r]], np.uint64)
            for j in range(first[r], first[r + 1]):
                x = mix(x * _U(BASE) + h[j : j + 1])
            extra[i] = x[0]
        row, g = np.concatenate([row, few]), np.concatenate([g, extra])
    return row, g
