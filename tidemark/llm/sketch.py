"""A count-min sketch of hashes that many tasks fill and that tells which hashes may occur more than once.

Each task turns its hashes into cells and sends its distinct cells as byte deltas, dealt by slices of the
sketch; a slice's lists are merged into a bitmap of the cells seen at least twice.  The estimate never
falls below the true count, so no repeated hash is lost.  The merged bitmap is broadcast compressed; its size is
``2**bits`` bits and never above ``2**MOST_BITS`` (128 MB; a caller may set less), whatever the corpus.  With more hashes
than cells more of them are estimated repeated, and the exact pass that follows does more work.

Where hashes outgrow any such bitmap, ``met`` counts for every set how many of its hashes are in another set as well: the hashes
are dealt by slices, each slice tells which of them it has twice, and only the sets come back, a few bits for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import chunks

MOST_BITS, FLUSH = 30, 2_000_000


@dataclass(frozen=True)
class Bitmap:
    """Cells seen at least twice.  Slices travel compressed and are unpacked once in each Python worker."""

    bits: int
    slices: tuple[bytes, ...]

    @cached_property
    def cells(self) -> np.ndarray:
        size = (1 << self.bits) // 8
        out, each = np.empty(size, np.uint8), size // len(self.slices)
        for i, x in enumerate(self.slices):
            out[i * each : (i + 1) * each] = np.frombuffer(pa.decompress(x, each, codec="zstd"), np.uint8)
        return out

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "slices": self.slices}

    def may_repeat(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes are estimated repeated."""
        at = hashes >> np.uint64(64 - self.bits)
        return (self.cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pack_deltas(sorted_values: np.ndarray) -> bytes:
    """Ascending integers as bytes: each 255 adds 255, any other byte ends a value."""
    d = np.diff(sorted_values.astype(np.int64), prepend=0)
    q = d // 255
    ends = np.cumsum(q + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = d % 255
    return out.tobytes()


def unpack_deltas(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    return np.cumsum(x, dtype=np.int64)[x != 255]


def bits_for(texts: DataFrame, bytes_per_hash: float = 6.0, most_bits: int = MOST_BITS) -> int:
    """Bits of a sketch with about eight cells a hash, from the bytes of all texts."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(8 * total / bytes_per_hash, 1))), 16, most_bits))


def of_texts(hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 1 << 20) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """For ``repeated``: the hashes of a ``text`` column; ``hashes(bytes, offsets)`` gives those of a chunk of texts, ``most`` bytes or one text."""

    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in chunks(batch, most=most):
            yield hashes(data, offsets)

    return run


def met(rows: DataFrame, sets: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]], n_hashes: int) -> DataFrame:
    """``key, row`` of the sets with enough hashes that another set has too; of some more, since a hash counts by 32 bits and its slice's.

    ``sets`` gives (hashes, how many of each set, how many must be met, ``key``, ``row``) of some sets at a time; ``n_hashes`` is about how many there are.
    A block of sets sends its hashes to slices of about a million, with the set of each; its keys go along with one of them.
    """
    bits = int(np.clip(np.ceil(np.log2(max(n_hashes / 1e6, 1))), 4, 12))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        block = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            h, n, least, key, row = (np.concatenate(x) for x in zip(*held))
            held.clear()
            part = (h >> np.uint64(64 - bits)).astype(np.uint16)
            by = np.argsort(part, kind="stable")  # sets ascend within a slice
            at = np.searchsorted(part[by], np.arange((1 << bits) + 1))
            cells, owner = (h >> np.uint64(32 - bits)).astype(np.uint32)[by], np.repeat(np.arange(len(n), dtype=np.int32), n)[by]
            home = block % (1 << bits)
            own = lambda x: pa.array([x.astype(np.int64).tobytes() if i == home else None for i in range(1 << bits)], pa.binary())
            return pa.RecordBatch.from_pydict({
                "slice": pa.array(np.arange(1 << bits, dtype=np.int32)), "block": pa.array(np.full(1 << bits, block)),
                "cells": pa.array([cells[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                "owners": pa.array([pack_deltas(owner[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary()),
                "least": own(least), "keys": own(key), "sets": own(row),
            })

        for batch in batches:
            for found in sets(batch):
                held.append(found)
                if sum(len(x[0]) for x in held) >= FLUSH // 2:
                    yield flush()
                    block += 1
        if held:
            yield flush()

    def twice(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in batch.select(["block", "cells", "owners", "least", "keys", "sets"]).to_pylist()]
        cells = np.concatenate([np.frombuffer(r["cells"], np.uint32) for r in held])
        by = np.argsort(cells)
        same = np.zeros(len(cells) + 1, bool)
        same[1:-1] = cells[by][1:] == cells[by][:-1]
        hit = np.empty(len(cells), bool)
        hit[by] = same[1:] | same[:-1]
        ends = np.cumsum([0, *(len(r["cells"]) // 4 for r in held)])
        for k in range(0, len(held), 100):
            some = range(k, min(k + 100, len(held)))
            owners = [pack_deltas(unpack_deltas(held[i]["owners"])[hit[ends[i] : ends[i + 1]]]) for i in some]
            rest = {c: pa.array([held[i][c] for i in some], pa.binary()) for c in ("least", "keys", "sets")}
            yield pa.RecordBatch.from_pydict({"block": pa.array([held[i]["block"] for i in some], pa.int64()), "owners": pa.array(owners, pa.binary()), **rest})

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, home = [np.zeros(0, np.int64)], {}
        for batch in batches:
            owners += [unpack_deltas(x.as_py()) for x in batch.column("owners")]
            for row in batch.filter(batch.column("keys").is_valid()).select(["least", "keys", "sets"]).to_pylist():
                home = {c: np.frombuffer(x, np.int64) for c, x in row.items()}
        enough = np.bincount(np.concatenate(owners), minlength=len(home["least"])) >= home["least"]
        yield pa.RecordBatch.from_pydict({"key": pa.array(home["keys"][enough]), "row": pa.array(home["sets"][enough])})

    binary = "least binary, keys binary, sets binary"
    dealt = rows.mapInArrow(deal, f"slice int, block long, cells binary, owners binary, {binary}")
    hits = dealt.groupBy("slice").applyInArrow(twice, f"block long, owners binary, {binary}")
    return hits.groupBy("block").applyInArrow(count, "key long, row long")


def repeated(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, slices: int | None = None, least: int = 2):
    """A broadcast ``Bitmap`` of ``2**bits`` cells: set where at least two of the hashes of ``rows`` fall; with ``least`` 1, where one does.

    The caller destroys it after the last action that uses it.
    """
    spark = rows.sparkSession
    slices = 1 << int(np.ceil(np.log2(max(slices or int(spark.conf.get("spark.sql.shuffle.partitions")), 16))))
    slices = min(slices, 1 << 12, 1 << (bits - 3))
    width = (1 << bits) // slices

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            held.clear()
            first = np.ones(len(cells), bool)
            first[1:] = cells[1:] != cells[:-1]
            again = np.unique(cells[~first])
            cells = cells[first]
            at, at2 = (np.searchsorted(x, np.arange(slices + 1, dtype=np.int64) * width) for x in (cells, again))
            return pa.RecordBatch.from_pydict({
                "slice": pa.array(np.arange(slices, dtype=np.int32)),
                "once": pa.array([pack_deltas(cells[at[i] : at[i + 1]] - i * width) for i in range(slices)], pa.binary()),
                "twice": pa.array([pack_deltas(again[at2[i] : at2[i + 1]] - i * width) for i in range(slices)], pa.binary()),
            })

        for batch in batches:
            for found in hashes(batch):
                held.append((found >> np.uint64(64 - bits)).astype(np.uint32))
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(width, bool), np.zeros(width, bool)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("twice")):
                cells = unpack_deltas(a.as_py())
                twice[cells[once[cells]]] = True
                once[cells] = True
                twice[unpack_deltas(b.as_py())] = True
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([pa.compress(np.packbits(twice if least == 2 else once, bitorder="little").tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    parts = rows.mapInArrow(fill, "slice int, once binary, twice binary").groupBy("slice").applyInArrow(merge, "slice int, bitmap binary")
    empty = pa.compress(bytes(width // 8), codec="zstd", asbytes=True)
    found = [empty] * slices
    for row in parts.toLocalIterator():  # one slice at a time; 2**bits bits in all
        found[row["slice"]] = bytes(row["bitmap"])
    return spark.sparkContext.broadcast(Bitmap(bits, tuple(found)))
