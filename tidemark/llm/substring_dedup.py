"""Removal of word windows that occur more than once, with a count-min prefilter.

First pass: every task sketches the anchors of its windows (see ``sketch``).  A window's anchor is the least hash
of its runs of about half a window, so equal windows have equal anchors at different places, and some ten
windows in a row share one: the merged counts of anchors overestimate how often a window occurs, from a tenth of
the entries.  Second pass: windows estimated repeated, and only those, are grouped exactly by a
96-bit hash of their words.  A task sends each distinct window once to its group; further places of a window
that it holds several times are settled and go straight to their documents' parts, so a window that a
third of all documents share sends one entry a task to its group.  Third pass: the repeated starts meet
their documents, whose rows have a 96-bit key, and the covered words go.

Defined cases: null and empty text have no words and keep an empty text; documents with fewer words than
a window keep all; windows are judged on the input; equal rows (same ``doc_id`` and text) are two
places like any other; null ``doc_id`` is kept; very long texts are read whole; further columns of the input
pass through, but for those named as the three of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm import sketch
from tidemark.llm.hashing import SPACED, Words, chunks, mix, window_hashes

_FLUSH = 1_000_000
_OWN = ("kept_text", "n_words", "n_removed")
_KEY, _KEY2, _PART = "substring dedup: key", "substring dedup: key 2", "substring dedup: part"


def _pack(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), codec="zstd", asbytes=True)


def _pack_places(key: np.ndarray, key2: np.ndarray, at: np.ndarray) -> bytes:
    return _pack(key, key2, np.diff(at, prepend=at.dtype.type(0)))


def _unpack_places(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, second keys and starts of ``n`` places."""
    raw = pa.decompress(packed, n * 16, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int32, n, n * 8), np.cumsum(np.frombuffer(raw, np.int32, n, n * 12), dtype=np.int32)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over every ``n`` neighbours."""
    span = 1
    while 2 * span <= n:
        x, span = f(x[:-span], x[span:]), 2 * span
    return f(x[: len(x) - (n - span)], x[n - span :]) if span < n else x


def _anchors(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the window at each of ``at``; the anchors of all places that are one to any of these windows)."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    size = max(1, window // 2)
    wide = window - size + 1
    runs = window_hashes(words, np.arange(len(words) - size + 1), size)
    least = _sliding(runs, wide, np.minimum)
    held = np.zeros(len(least) + 2 * (wide - 1), np.uint64)
    held[at + wide - 1] = least[at]
    places = _sliding(held, wide, np.maximum) == runs  # the greatest minimum of the windows over a run is the run itself
    return mix(least[at], 31), mix(runs[places], 31)


def dedup(docs: DataFrame, window: int = 35, bucket_windows: int = 500_000, part_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``kept_text, n_words, n_removed``; kept words are joined by one space."""
    texts = docs.select("doc_id", "text")
    bits = sketch.bits_for(texts, bytes_per_hash=window / 12)  # about twenty cells an anchor
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = max(16, int(total / 6 / 3 / bucket_windows)), max(8, int(total / part_bytes))

    def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = Words(data, offsets, SPACED)
        h = w.hashes(data)
        return _anchors(h, w.windows(h, window)[0], window)[1]

    bitmap = sketch.repeated(texts.select("text"), sketch.of_texts(hashes), bits)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            h, h2, key, key2, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((h2, h))
            same = (h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            first = np.append(True, ~same)
            many = np.append(same, False) | ~first
            sent, known = np.zeros(len(h), bool), np.zeros(len(h), bool)
            sent[order[first]] = True
            known[order[many]] = True
            rows = []
            # Settled places have negative groups, one a part: nothing is left to compare.
            group = np.where(sent, (h % np.uint64(buckets)).astype(np.int64), -1 - _part_of(key, parts))
            i = np.flatnonzero(sent | known)
            i = i[np.argsort(group[i], kind="stable")]
            edges = np.flatnonzero(np.append(True, group[i][1:] != group[i][:-1]))
            for j in np.split(i, edges[1:]):
                g = int(group[j[0]])
                rows.append((g, len(j), _pack(h[j], h2[j], known[j]) if g >= 0 else b"", _pack_places(key[j], key2[j], at[j])))
            return pa.RecordBatch.from_pydict(dict(zip(("bucket", "n", "hashes", "places"), map(pa.array, zip(*rows)))), schema=pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary())]))

        for batch in batches:
            for a, b, data, offsets in chunks(batch):
                w = Words(data, offsets, SPACED)
                words = w.hashes(data)
                i, doc = w.windows(words, window)
                k = np.flatnonzero(bitmap.value.may_repeat(_anchors(words, i, window)[0]))
                if not len(k):
                    continue
                h = window_hashes(words, i[k], window)
                h2 = (window_hashes(words, i[k], window, second=True) >> np.uint64(32)).astype(np.uint32)
                key, key2 = (batch.column(c).slice(a, b - a).to_numpy()[doc[k]] for c in (_KEY, _KEY2))
                held.append((h, h2, key, key2, (i[k] - w.first[doc[k]]).astype(np.int32)))
                if sum(len(x[0]) for x in held) >= _FLUSH:
                    yield flush()
        if held:
            yield flush()

    def exact(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if group[0].as_py() < 0:
            part = -1 - group[0].as_py()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int64)), batch.column("n"), batch.column("places")], names=["part", "m", "starts"])
            return
        h, h2, known, places = [], [], [], []
        for batch in batches:
            for n, hashed, packed in zip(*(batch.column(c).to_pylist() for c in ("n", "hashes", "places"))):
                raw = pa.decompress(hashed, n * 13, codec="zstd", asbytes=True)
                h.append(np.frombuffer(raw, np.uint64, n))
                h2.append(np.frombuffer(raw, np.uint32, n, n * 8))
                known.append(np.frombuffer(raw, bool, n, n * 12))
                places.append(_unpack_places(packed, n))
        a, b = np.concatenate(h), np.concatenate(h2)
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        again = np.concatenate(known)
        again[order[np.append(same, False) | np.append(False, same)]] = True
        key, key2, at = (np.concatenate(x)[again] for x in zip(*places))
        part = _part_of(key, parts)
        order = np.lexsort((at, key, part))
        key, key2, at, part = key[order], key2[order], at[order], part[order]
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for x, y in zip(edges, [*edges[1:], len(part)]):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part[x]], pa.int64()), "m": pa.array([y - x], pa.int64()), "starts": pa.array([_pack_places(key[x:y], key2[x:y], at[x:y])], pa.binary())})

    mine = docs.drop(*_OWN)
    keyed = mine.withColumns({_KEY: F.xxhash64("doc_id", "text"), _KEY2: F.hash("doc_id", "text", F.lit(1))})
    found = keyed.select("text", _KEY, _KEY2).mapInArrow(candidates, "bucket long, n long, hashes binary, places binary")
    found = found.groupBy("bucket").applyInArrow(exact, "part long, m long, starts binary")

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        held = [_unpack_places(s, n) for n, s in zip(right.column("m").to_pylist(), right.column("starts").to_pylist())]
        owner, owner2, start = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        order = np.lexsort((owner2, owner))
        owner, owner2, start = owner[order], owner2[order], start[order].astype(np.int64)
        fresh = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (owner2[1:] != owner2[:-1]))) if len(owner) else np.zeros(0, np.int64)
        place = {k: (x, y) for k, x, y in zip(zip(owner[fresh].tolist(), owner2[fresh].tolist()), fresh.tolist(), [*fresh[1:].tolist(), len(owner)])}
        out = []
        for batch in left.combine_chunks().to_batches():
            for a, b, data, offsets in chunks(batch):
                w = Words(data, offsets, SPACED)
                keys = (batch.column(c).slice(a, b - a).to_pylist() for c in (_KEY, _KEY2))
                lo, hi = np.array([place.get(k, (0, 0)) for k in zip(*keys)], np.int64).T
                n = hi - lo
                at = start[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] + np.repeat(w.first[:-1], n)
                cover = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, np.minimum(at + window, len(w.starts)), -1)
                keep = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                size = w.ends[keep] - w.starts[keep] + 1
                ends = np.cumsum(size)
                text = np.full(int(size.sum()), 0x20, np.uint8)
                inner = np.arange(int(size.sum())) - np.repeat(ends - size, size)
                real = inner < np.repeat(size - 1, size)
                text[real] = data[(np.repeat(w.starts[keep], size) + inner)[real]]
                per_doc = np.diff(np.searchsorted(keep, w.first))
                edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_doc)])]
                joined = text.tobytes()
                kept = [joined[x : max(y - 1, x)].decode() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
                part = batch.slice(a, b - a)
                cols = [part.column(c) for c in names]
                out.append(pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string()), pa.array(w.counts.astype(np.int64)), pa.array((w.counts - per_doc).astype(np.int64))], names=[*names, *_OWN]))
        return pa.Table.from_batches(out) if out else left.select([]).slice(0, 0)

    names = mine.columns
    schema = StructType([*mine.schema.fields, StructField("kept_text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    dealt = keyed.withColumn(_PART, _part(_KEY, parts))
    return dealt.groupBy(_PART).cogroup(found.groupBy("part")).applyInArrow(cut, schema)


def _part(key: str, parts: int):
    """``key`` as an unsigned integer modulo ``parts``."""
    high, low = F.shiftrightunsigned(key, 32), F.col(key).bitwiseAND(F.lit(0xFFFFFFFF))
    return (high * (2**32 % parts) + low) % parts


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (key.view(np.uint64) % np.uint64(parts)).astype(np.int64)
