"""Vectorised hashing of words and word windows over Arrow string columns.

A chunk of texts is one byte array; words are found by a byte table, and the hash of a word is a
polynomial over its bytes taken from one running sum, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _odd(seed: int) -> int:
    return (int(np.random.default_rng(seed).integers(2**40, 2**62)) * 8 + 5) % 2**64


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.inverse = pow(self.base, -1, 2**64)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(m, b, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _WORDS2 = Powers(11), Powers(12), Powers(13)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of ``h``."""
    h = h + U64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def spaced() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def lettered() -> np.ndarray:
    """Bytes of words of ASCII letters and digits and of all other scripts."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lowered() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


SPACED, LETTERED, LOWER = spaced(), lettered(), lowered()


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``most`` bytes of text; null is empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n), data[offsets[a] : offsets[min(b, n)]], offsets[a : min(b, n) + 1] - offsets[a]
        a = min(b, n)


class Words:
    """The words of a chunk: byte spans, the document of each, and where each document's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        mask = table[data]
        before = np.zeros(len(mask) + 1, bool)
        before[1:] = mask
        after = np.zeros(len(mask) + 1, bool)
        after[:-1] = mask
        before[offsets] = False
        after[offsets] = False
        self.starts = np.flatnonzero(mask & ~before[:-1])
        self.ends = np.flatnonzero(mask & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        up, down = _BYTES.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * up[:-1], out=total[1:], dtype=U64)
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, document) of every run of ``size`` words within one document."""
        per_doc = np.maximum(self.counts - size + 1, 0)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        skipped = np.cumsum(per_doc) - per_doc
        return np.arange(len(doc)) + (self.first[:-1] - skipped)[doc], doc


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int | np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of the ``size`` words from each index of ``at``; ``second`` takes an independent function."""
    up, down = (_WORDS2 if second else _WORDS).upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[:-1], out=total[1:], dtype=U64)
    return mix((total[at + size] - total[at]) * down[at], 7 if second else 3)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash, never 0, of the bytes of each span of ``data``."""
    up, down = _BYTES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:], dtype=U64)
    return mix((total[ends] - total[starts]) * down[starts]) | U64(1)
