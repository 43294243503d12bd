"""Packing of token ids into sequences: bounded-space online best fit.

Each task reads its documents in order and keeps at most ``open_windows`` unfinished sequences.  A
document longer than a sequence is cut into whole sequences first; what is left goes into the open
sequence that it fills best.  When none has room, the fullest is emitted; a gap of ``top_up`` ids or
more is first filled from the document at hand.  What stays open is packed again over ever fewer
tasks (``fan_in`` tasks into one a level), and the very last ids are laid end to end, the last
sequence cut at powers of two, so the whole corpus ends without padding there.

Output, one row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

Defined cases: null or empty text is a document of one id (the end id); null ``doc_id`` and repeated
rows are packed like any row; a text longer than a window is cut into pieces, however long; of open
sequences that fit a piece equally well the first slot is taken; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens, workspace
from tidemark.llm.hashing import chunks

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"
_PIECE = SCHEMA + ", open boolean, task long"

#: Bytes of text encoded at once: its arrays take some 70 times as much, in every worker.
CHUNK = 1 << 18


def _own(piece: tuple) -> tuple:
    """A piece with its own ids: an open sequence that holds a slice keeps the whole chunk in memory."""
    doc, start, ids, total = piece
    return doc, start, ids.copy(), total


class Packer:
    """Best fit with a bounded number of open sequences.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, size: int, open_windows: int, top_up: int):
        self.next_id, self.size, self.most, self.top_up = first_id, size, open_windows, top_up
        self.held: list[list] = []
        self.free = np.zeros(0, np.int64)
        self.done: list[tuple] = []

    def emit(self, pieces: list, open_: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), total, self.next_id, at, ids, open_))
            at += len(ids)
        self.next_id += 1

    def place(self, k: int, piece: tuple) -> None:
        self.held[k].append(_own(piece))
        self.free[k] -= len(piece[2])
        if not self.free[k]:
            self.release(k)

    def release(self, k: int) -> None:
        self.emit(self.held.pop(k))
        self.free = np.delete(self.free, k)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self.emit([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        room = self.free - len(ids)
        if len(room) and room.max() >= 0:
            self.place(int(np.where(room < 0, self.size, room).argmin()), (doc, start, ids, total))
            return
        if len(self.held) >= self.most:
            k = int(self.free.argmin())
            gap = int(self.free[k])
            if gap >= self.top_up:
                self.place(k, (doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            else:
                self.release(k)
        self.held.append([_own((doc, start, ids, total))])
        self.free = np.append(self.free, self.size - len(ids))

    def leave_open(self) -> None:
        for pieces in self.held:
            self.emit(pieces, True)
        self.held, self.free = [], np.zeros(0, np.int64)

    def lay_end_to_end(self) -> None:
        """Whole sequences from everything still open, then powers of two."""
        rest = [p for pieces in self.held for p in pieces]
        left = sum(len(p[2]) for p in rest)
        self.held, self.free = [], np.zeros(0, np.int64)
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            row = []
            while room:
                doc, start, ids, total = rest.pop(0)
                row.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self.emit(row)

    def take(self, task: int) -> pa.RecordBatch:
        done, self.done = self.done, []
        col = list(zip(*done)) if done else [[]] * 8
        flat = np.concatenate(col[6]).astype(np.int32) if done else np.zeros(0, np.int32)
        n = np.array(col[2], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays(
            [pa.array(col[0], pa.int64()), pa.array(col[1], pa.int64()), pa.array(n), pa.array(col[3], pa.int64()), pa.array(col[4], pa.int64()), pa.array(col[5], pa.int64()), lists, pa.array(col[7], pa.bool_()), pa.array(np.full(len(n), task, np.int64))],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open", "task"],
        )


def pack(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 1, open_windows: int = 64, top_up: int = 64, fan_in: int = 16) -> DataFrame:
    """Pack ``docs(doc_id, text)``; see the module text.

    The first level runs where the texts are read, without a shuffle.  Later levels move only the open
    sequences (at most ``open_windows`` a task) and each is written before the next begins.
    """
    tokenizer = tokenizer or tokens.default_path()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        packer = Packer(task << 32, size, open_windows, top_up)
        for batch in batches:
            for a, b, data, offsets in chunks(batch, most=CHUNK):
                flat, n = enc.encode_chunk_with_end(data, offsets, end_id)
                at = 0
                for doc, length in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), n.tolist()):
                    packer.add(doc, 0, flat[at : at + length], length)
                    at += length
                yield packer.take(task)
        packer.leave_open()
        yield packer.take(task)

    def again(level: int, last: bool):
        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = key[0].as_py()
            packer = Packer((level << 56) + (task << 32), size, open_windows, top_up)
            for batch in batches:
                for piece in _pieces(batch):
                    packer.add(*piece)
                yield packer.take(task)
            if last:
                packer.lay_end_to_end()
            else:
                packer.leave_open()
            yield packer.take(task)

        return run

    rows = workspace.written(texts.mapInArrow(first, _PIECE), "packed")
    finished, open_rows = rows.filter("not open"), rows.filter("open")
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        groups = -(-tasks // fan_in)
        last = groups == 1
        key = F.expr(f"task div {fan_in}").alias("task")
        moved = open_rows.withColumn("task", key)
        packed = workspace.written(moved.groupBy("task").applyInArrow(again(level, last), _PIECE), "packed")
        finished = finished.unionByName(packed.filter("not open"))
        if last:
            return finished.drop("open", "task")
        open_rows, tasks = packed.filter("open"), groups


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
    ids = batch.column("ids")
    flat, at = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    at = at - at[0]
    for i, (doc, start, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")))):
        yield doc, start, flat[at[i] : at[i + 1]].astype(np.uint32), total
