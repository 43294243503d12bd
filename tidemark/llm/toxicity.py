"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all texts are the unlabelled rest.  A linear classifier over
the distinct words of a text minimises the class-prior-corrected risk
``prior * R+(P) + max(0, R-(U) - prior * R-(P))``; where the second part turns negative its gradient is
reversed, so the classifier can't pay for a good fit of the positives with a negative risk of the rest.

Fitting uses a bounded sample: about ``max_positive`` positives and ``max_unlabelled`` texts, fewer where they would
have more than ``max_bytes`` of text together, taken by a hash of ``doc_id``; the class prior and the shares behind
the sample are counted over all rows.  Scoring
reads every word of every text and needs no shuffle.

Defined cases: null and empty text get the score of a text without words; a document labelled more than
once is toxic if any label says so; null labels and null ``doc_id`` teach nothing; without positives every
score is 0; repeated rows give repeated results; very long texts are read whole; further columns pass through, but for
one named ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.hashing import LETTERED, LOWER, Words, chunks


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes of the words that count
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = Words(data, offsets, LETTERED)
        h = found.hashes(LOWER[data])
        z = np.full(len(offsets) - 1, self.bias)
        if len(self.words) and len(h):
            quick = np.zeros(1 << 20, bool)
            quick[(self.words >> np.uint64(44)).astype(np.int64)] = True
            at = np.flatnonzero(quick[(h >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
            same = self.words[k] == h[at]
            at, k = at[same], k[same]
            doc = np.searchsorted(found.first, at, side="right") - 1
            once = np.unique(doc * len(self.words) + k)
            z += np.bincount(once // len(self.words), weights=self.weights[once % len(self.words)], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _draw(share: float):
    return F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003 < share


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000, max_bytes: int = 32 << 20, n_words: int = 512, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.agg(F.count("*").alias("all"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("toxic")).first()
    if not n["toxic"]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -60.0)
    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    total = size["rows"]
    fits = max_bytes / 2 / max(size["bytes"] / max(total, 1), 1)  # texts of the mean size in half of max_bytes
    max_positive, max_unlabelled = min(max_positive, fits), min(max_unlabelled, fits)
    confirmed = marks.filter("toxic = 1").filter(_draw(max_positive / n["toxic"])).select("doc_id")  # about max_positive ids
    positive = rows.join(F.broadcast(confirmed), "doc_id", "left_semi").withColumn("positive", F.lit(True))
    unlabelled = rows.filter(_draw(max_unlabelled / max(total, 1))).withColumn("positive", F.lit(False))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch):
                w = Words(data, offsets, LETTERED)
                h = w.hashes(LOWER[data]).view(np.int64)
                lists = [np.unique(h[w.first[i] : w.first[i + 1]]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("positive").slice(a, b - a), pa.array(lists, pa.list_(pa.int64()))], names=["positive", "words"])

    found = positive.unionByName(unlabelled).mapInArrow(words, "positive boolean, words array<long>").toArrow()
    return _train(found, n["toxic"] / n["all"], n_words, steps, rate, decay)


def _train(found: pa.Table, prior: float, n_words: int, steps: int, rate: float, decay: float) -> Model:
    positive = found.column("positive").to_numpy()
    lists = found.column("words").combine_chunks()
    flat = lists.flatten().to_numpy().view(np.uint64)
    doc = np.repeat(np.arange(len(positive)), np.diff(lists.offsets.to_numpy()))
    vocab, at = np.unique(flat, return_inverse=True)
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    p = np.bincount(at, weights=positive[doc], minlength=len(vocab)) / n_p
    u = np.bincount(at, weights=~positive[doc], minlength=len(vocab)) / n_u
    apart = abs(p - u) / np.sqrt((p + 1 / n_p) * (1 - np.minimum(p, 0.999)) / n_p + (u + 1 / n_u) * (1 - np.minimum(u, 0.999)) / n_u)
    chosen = np.sort(np.argsort(-apart, kind="stable")[:n_words])
    column = np.full(len(vocab), -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(positive), len(chosen)), np.float32)
    used = column[at] >= 0
    x[doc[used], column[at][used]] = 1
    xp, xu = x[positive], x[~positive]
    w, bias = np.zeros(len(chosen), np.float32), float(np.log(prior / max(1 - prior, 1e-6)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = np.clip(xp @ w + bias, -60, 60), np.clip(xu @ w + bias, -60, 60)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))  # d/dz of log(1+e^z) is s, of log(1+e^-z) is s-1
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_rest = lambda c_p, c_u: np.append(xu.T @ c_u - prior * (xp.T @ c_p), c_u.sum() - prior * c_p.sum())
        g = g_rest((sp / len(sp)).astype(np.float32), (su / len(su)).astype(np.float32))
        if rest < 0:
            g = -g
        else:
            c = (prior * (sp - 1) / len(sp)).astype(np.float32)
            g = g + np.append(xp.T @ c, c.sum())
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1].astype(np.float32)
        bias -= step[-1]
    return Model(vocab[chosen], w.astype(np.float64), bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but a clashing one, with ``score``."""
    kept = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(data, offsets))], names=[*part.schema.names, "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
