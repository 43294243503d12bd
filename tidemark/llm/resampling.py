"""Importance resampling towards a target text distribution, over hashed word runs.

1. Streams: every text becomes its feature buckets (crc32 of each run of one to ``longest`` words, modulo
   ``n_buckets``), packed as unsigned 16-bit numbers; a row of the written table is one block of texts: their
   ids, their offsets into the block's stream, and the stream.  Words are read and hashed once.
2. Counts, an external sort: each task sorts its streams block by block, run-length encodes them and adds the runs up,
   so it sends at most ``n_buckets`` counts on, which Spark sums.
3. Gains: a bucket's smoothed log ratio of the target's share to the corpus's share, ``n_buckets`` numbers.
4. Weights: the streams are read again; the gains of a block are gathered by its stream and summed a document with
   ``np.add.reduceat``.
5. A Gumbel draw without replacement: the weight plus noise from a hash of the id is the score, and the highest scores
   are drawn.  Ranks come from ranges of the score, so no task sees all rows.

Defined cases: null and empty text, and text without words, have no features and weight 0; null ``doc_id`` hashes as the
empty text; rows with equal ``doc_id`` each have their own weight and a rank of their own, more features first, and equal
rows may swap ranks; ties go to the smaller ``doc_id``, null first; empty tables give no rows, an empty target an equal
share for every bucket; texts of any length are read whole; columns but ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import crc, numbering, workspace
from tidemark.llm.hashing import LETTERED, LOWER, Words, chunks

BUCKETS, SCALE = 10_000, 1000
STREAMS = "ids array<long>, n_words array<int>, offsets array<long>, stream binary"


def features(data: np.ndarray, offsets: np.ndarray, n_buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts: words of each, where each one's features begin (and end), and all buckets text by text."""
    data = LOWER[data]
    found = Words(data, offsets, LETTERED)
    n = found.counts
    per_doc = sum(np.maximum(n - r, 0) for r in range(longest))
    at = np.concatenate([[0], np.cumsum(per_doc)])
    stream = np.empty(at[-1], np.uint16)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(doc)) - found.first[:-1][doc]  # of each word in its text
    words = crc.of_spans(data, found.starts, found.ends)
    run, begin = words, at[:-1].copy()
    for r in range(longest):
        if r:  # runs of r + 1 words: those of r words, each with the next word
            whole = np.flatnonzero(place[: len(run)] < (n - r)[doc[: len(run)]])
            longer = np.zeros(len(run), np.uint32)
            longer[whole] = crc.joined(run[whole], data, found.starts[whole + r], found.ends[whole + r], words[whole + r])
            run = longer
        else:
            whole = np.arange(len(run))
        stream[begin[doc[whole]] + place[whole]] = run[whole] % np.uint32(n_buckets)
        begin += np.maximum(n - r, 0)
    return n, at, stream


def streams(docs: DataFrame, name: str, n_buckets: int = BUCKETS, longest: int = 2, doc_id: str = "doc_id") -> DataFrame:
    """The written table of ``STREAMS``, blocks of about a megabyte of text."""
    if n_buckets > 1 << 16:
        raise ValueError("a bucket has 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch, most=1 << 20):
                n, at, stream = features(data, offsets, n_buckets, longest)
                ids = batch.column("id").slice(a, b - a)
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays([one(ids, pa.int64()), one(n, pa.int32()), one(at, pa.int64()), pa.array([stream.astype("<u2").tobytes()], pa.binary())], names=["ids", "n_words", "offsets", "stream"])

    return workspace.written(docs.select(F.col(doc_id).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, STREAMS), name)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length encoding: each value once, and how often it stands."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, int)
    return sorted_values[starts], np.diff(np.append(starts, len(sorted_values)))


def bucket_counts(packed: DataFrame) -> DataFrame:
    """``bucket, n`` over all streams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for block in batch.column("stream"):
                values, n = runs(np.sort(np.frombuffer(block.as_buffer(), "<u2"), kind="stable"))  # a radix sort
                total[values] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return packed.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, by bucket; reads ``n_buckets`` counts of each side at most."""
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for side, counts in ((s, corpus), (t, target)):
        for r in counts.collect():
            side[r["bucket"]] = r["n"]
    top, low = (t + 1) * (s.sum() + n_buckets), (s + 1) * (t.sum() + n_buckets)
    return np.array([math.floor(SCALE * math.log(x)) for x in top / low], np.int64)


def weigh(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document; ``weight`` is the floored mean of its features' gains."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                at = batch.column("offsets")[i].values.to_numpy()
                stream = np.frombuffer(batch.column("stream")[i].as_buffer(), "<u2")
                n = np.diff(at)
                some = np.flatnonzero(n)  # reduceat has no empty sums
                weight = np.zeros(len(n), np.int64)
                if len(some):
                    weight[some] = np.add.reduceat(gain[stream], at[some]) // n[some]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("n_words")[i].values, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(gather, "doc_id long, n_words int, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel variable from the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, per_range: int = 1_000_000) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: the ``percent`` highest scores of documents with enough words have ranks."""
    scored = weighed.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()})
    scored = workspace.written(scored, "scored")
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").desc(), F.col("row").asc()]  # the last splits equal rows
    rows = numbering.dealt(scored.filter(fit), order, "drawn", per_range)
    drawn = rows.count() * percent // 100
    ranked = numbering.numbered(rows, "number").withColumn("rank", F.when(F.col("number") < drawn, F.col("number") + 1))
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")).select(*out))


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, longest: int = 2, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Draw ``percent`` of ``docs(doc_id, text)`` towards the distribution of ``target(text)``."""
    own = streams(docs, "streams", n_buckets, longest)
    aim = streams(target.select("text").withColumn("doc_id", F.lit(None).cast("long")), "target", n_buckets, longest)
    return draw(weigh(own, gains(bucket_counts(own), bucket_counts(aim), n_buckets)), percent, least_words, seed)
