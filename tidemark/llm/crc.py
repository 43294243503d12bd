"""crc32 of many byte spans at once, and of runs of neighbouring spans, without a Python step for each.

A crc is linear over bits, so the crc of ``a`` followed by ``b`` is the crc of ``a`` moved on by the length of ``b``,
combined with the crc of ``b``; the move is four table look-ups for each length.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Spans up to this many bytes go through the tables together; longer ones, rare among words, one by one.
SHORT = 32
_ONES, _BYTE, _EIGHT = np.uint32(0xFFFFFFFF), np.uint32(0xFF), np.uint32(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The crc of each byte, and by how many bytes a crc's four bytes are moved on."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (table & np.uint32(1)) * np.uint32(0xEDB88320)  # the polynomial of zlib
    moved = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for j in range(4):
        moved[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for n in range(SHORT):
        moved[n + 1] = (moved[n] >> _EIGHT) ^ table[moved[n] & _BYTE]
    return table, moved


_TABLE, _MOVED = _tables()


def of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of the bytes of each span of ``data``."""
    n = ends - starts
    order = np.argsort(-np.minimum(n, SHORT + 1), kind="stable")  # long spans first, so those with a k-th byte are a prefix
    size, begin = n[order], starts[order]
    first = int(np.searchsorted(-size, -SHORT, side="left"))
    crc = np.full(len(n), _ONES)
    for k in range(int(size[first]) if first < len(size) else 0):
        last = int(np.searchsorted(-size[first:], -k, side="left")) + first
        part = crc[first:last]
        crc[first:last] = (part >> _EIGHT) ^ _TABLE[(part ^ data[begin[first:last] + k]) & _BYTE]
    out = np.empty(len(n), np.uint32)
    out[order] = crc ^ _ONES
    for i in order[:first]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def joined(before: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """crc32 of a text with crc ``before``, a space, and the span, whose own crc is in ``crcs``."""
    spaced = before ^ _ONES
    spaced = ((spaced >> _EIGHT) ^ _TABLE[(spaced ^ np.uint32(0x20)) & _BYTE]) ^ _ONES
    n = ends - starts
    move = _MOVED.reshape(-1)
    row = np.minimum(n, SHORT) * 1024
    out = crcs.copy()
    for j in range(4):
        out ^= move[row + 256 * j + ((spaced >> np.uint32(8 * j)) & _BYTE)]
    for i in np.flatnonzero(n > SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(spaced[i]))
    return out
