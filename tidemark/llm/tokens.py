"""Token ids of whole texts by a public tokenizer file, exact and fast.

Plain Western text is cut into the tokenizer's own pre-tokens by byte classes; each distinct pre-token
goes through the tokenizer library once per worker and is then found by its 64-bit hash.  Every other
text takes the library's normal path, so both give ``Tokenizer.encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from tidemark.llm.hashing import LOWER, piece_hashes

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _classes() -> np.ndarray:
    """Class of each byte: white space, letters (with the bytes of U+00C0 to U+00FF), digits, other, unknown."""
    t = np.full(256, _OTHER, np.uint8)
    t[:0x20] = t[0x7F:] = _ODD
    t[[0x20, *range(0x09, 0x0E)]] = _SPACE
    t[0x30:0x3A] = _DIGIT
    t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:0xC0] = t[0xC3] = _LETTER
    return t


_CLASS = _classes()
_LATE = np.isin(np.arange(256), list(b"strvmldSTRVMLD"))  # first letters of the tokenizer's pre-tokens 's 't 're 've 'm 'll 'd


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Table:
    """Numbers by 64-bit hash: open addressing in two arrays."""

    def __init__(self, bits: int = 21):
        self.keys, self.values, self.mask, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64((1 << bits) - 1), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is new."""
        out, left, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), h & self.mask
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (key != 0)
            left, slot = left[more], (slot[more] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Number new distinct hashes from ``n`` on."""
        number, left, slot = np.arange(self.n, self.n + len(h), dtype=np.int32), np.arange(len(h)), h & self.mask
        self.n += len(h)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            won = self.keys[slot] == h[left]
            self.values[slot[won]] = number[left[won]]
            left, slot = left[~won], (slot[~won] + np.uint64(1)) & self.mask


class Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 16, dtype), 0

    def extend(self, x: np.ndarray) -> None:
        while self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


class Encoder:
    """Ids of texts.  ``most`` bounds the remembered pre-tokens of a worker."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        lower = any(x.get("type") == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.quick = bool(lower and suffix)
        if self.quick:
            self.pieces = Tokenizer(self.full.model)  # both read one vocabulary
            self.pieces.normalizer = normalizers.Sequence([])
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = spec["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.table, self.flat, self.size = Table(), Grown(np.uint16 if not self.quick or len(self.last) <= 1 << 16 else np.uint32), Grown(np.int32)
        self.at = Grown(np.int64)

    def learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 500):
            part = words[a : a + 500]
            ids = np.array(self.pieces.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):  # a pre-token without an end mark: one by one
                each = [self.pieces.encode(w, add_special_tokens=False).ids for w in part]
                ids, ends = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
            n = np.diff(ends, prepend=0)
            self.at.extend(self.flat.n + ends - n)
            self.size.extend(n)
            self.flat.extend(ids)

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk one after the other, number of ids of each)."""
        n_docs = len(offsets) - 1
        odd = np.ones(n_docs, bool)
        if self.quick and len(data):
            kind = _CLASS[data]
            late = data[1:]
            after_c3 = data[:-1] == 0xC3
            bad = kind == _ODD
            bad[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (~after_c3 | (late == 0x97) | (late == 0xB7))
            bad[1:] |= (data[:-1] == 0x27) & _LATE[late] | (data[:-1] == 0x3C) & (late == 0x7C)
            bad[0] |= data[0] >= 0x80 and data[0] != 0xC3
            total = np.concatenate([[0], np.cumsum(bad)])
            odd = total[offsets[1:]] > total[offsets[:-1]]
            low = LOWER[data]
            low[1:][after_c3 & (late >= 0x80) & (late <= 0x9E)] += 0x20
            first = np.ones(len(data), bool)
            first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            first[offsets[:-1][offsets[:-1] < len(data)]] = True
            edges = np.flatnonzero(first)
            ends = np.append(edges[1:], len(data))
            doc = np.searchsorted(offsets, edges, side="right") - 1
            keep = (kind[edges] != _SPACE) & ~odd[doc]
            edges, ends, doc = edges[keep], ends[keep], doc[keep]
            h = piece_hashes(low, edges, ends)
            if self.table.n > self.most:
                self.forget()
            number = self.table.find(h)
            new = np.flatnonzero(number < 0)
            if len(new):
                fresh, where = np.unique(h[new], return_index=True)
                raw = low.tobytes()
                self.learn([raw[a:b].decode() for a, b in zip(edges[new[where]].tolist(), ends[new[where]].tolist())])
                self.table.add(fresh)
                number[new] = self.table.find(h[new])
            size = self.size.data[number].astype(np.int64)
            counts = np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64)
            shift = np.cumsum(size) - size
            flat = self.flat.data[np.repeat(self.at.data[number] - shift, size) + np.arange(int(size.sum()))].astype(np.uint32)
        else:
            counts, flat = np.zeros(n_docs, np.int64), np.zeros(0, np.uint32)
        slow = [i for i in np.flatnonzero(odd).tolist() if offsets[i + 1] > offsets[i]]
        if slow:
            raw = data.tobytes()
            got = self.full.encode_batch_fast([raw[offsets[i] : offsets[i + 1]].decode() for i in slow], add_special_tokens=False)
            before = np.concatenate([[0], np.cumsum(counts)])
            parts, at = [], 0
            for i, e in zip(slow, got):
                parts += [flat[at : before[i]], np.array(e.ids, np.uint32)]
                at, counts[i] = before[i], len(e.ids)
            flat = np.concatenate([*parts, flat[at:]])
        return flat, counts

    def encode_chunk_with_end(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_chunk``, with ``end_id`` after the ids of each text."""
        flat, n = self.encode_chunk(data, offsets)
        n = n + 1
        out = np.full(len(flat) + len(n), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(n) - 1] = False
        out[keep] = flat
        return out, n


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
