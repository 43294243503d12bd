"""Token-id files: ORC stripes with run-length-encoded ids, row indexes and Bloom filters on ``doc_id``.

Layout of a directory: one ORC file per range of ``doc_id``, about ``part_mb`` of text each, rows in
ascending ``doc_id`` order.  ORC encodes the integer columns with run-length encoding (v2), keeps
minimum and maximum of every column per stripe and per ``row_stride`` rows, and a Bloom filter on
``doc_id``, so a reader takes stripes in parallel and skips those that can't hold a document.

Columns: ``doc_id, part, part_start, n_tokens, ids``; ``part`` numbers the ranges in ascending order and
``part_start`` counts the ids before the document within its part.

Defined cases: null or empty text gives only the end id; null ``doc_id`` sorts first; rows with equal
``doc_id`` are ordered by their text's hash and each keeps its own ids; an empty table gives an empty
directory that reads back as no rows; very long texts are encoded whole; other columns of the input are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens, workspace
from tidemark.llm.hashing import chunks

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, part_mb: int = 256, stripe_mb: int = 32, row_stride: int = 1000, false_positives: float = 0.01) -> None:
    """Encode ``docs(doc_id, text)`` and write the directory ``path``.

    One shuffle: texts are dealt by ranges of ``doc_id`` and sorted inside each range, then encoded and
    written by the same task.  Writing is idempotent per task, so a lost executor only repeats its parts.
    """
    tokenizer = tokenizer or tokens.default_path()
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = workspace.parts_for(total, part_mb << 20, spark.sparkContext.defaultParallelism * 2)
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, before = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, offsets in chunks(batch, most=1 << 20):
                flat, n = enc.encode_chunk_with_end(data, offsets, end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(before + ends - n), pa.array(n), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                before += int(ends[-1])

    (dealt.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", row_stride)
     .option("orc.stripe.size", stripe_mb << 20).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", false_positives).orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a directory; filters on ``doc_id`` reach the stripes' indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def starts(files: DataFrame) -> DataFrame:
    """``files`` with ``start``: the ids of all documents before, in ascending ``doc_id`` order.

    Only one row per part is summed in order and broadcast: as many rows as the directory has parts.
    """
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return files.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def ids_crc32(column: str | Column) -> Column:
    """Unsigned crc32 of an id array as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def crc(ids):
        return ids.map(lambda x: zlib.crc32(np.asarray(x, dtype="<u4").tobytes()))

    return crc(column)


def digests(files: DataFrame) -> DataFrame:
    """Per document of a read directory: where its ids start, how many, and their crc32."""
    return starts(files).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"), "part")
