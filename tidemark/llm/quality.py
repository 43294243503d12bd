"""Document quality from line labels: a linear-chain conditional random field marks every line good or bad.

A line's evidence is a sum of learned weights over binned features of itself and of the lines before and after it
(length, kinds of signs, words that repeat, symbols in words ...).  Forward and backward messages of the two-state chain
give each line's probability of being good; their mean, weighted by the lines' bytes, is calibrated to a score.

Labels are of documents, so lines are labelled in two rounds: first every line has its document's label; then those
lines of bad documents that look good alone are relabelled, but for the worst one, and the chain with its transitions is
fitted on these.  Fitting uses a bounded sample: about ``max_train`` labelled documents of each class, taken by a
hash of ``doc_id``, fewer where they would have more than ``max_bytes`` (a line counts 72 bytes more than its text), and none
that has a 64th of that alone.  The classes' shares are counted over all labels.  Scoring reads every line of every
text and needs no shuffle.

Defined cases: lines end with a line feed; lines without a word are left out of the chain; null and empty text, and text
without words, score the share of good labels; without labels every score is 0.5, with one class only its label;
a document labelled more than once is bad if any label says so; null labels and null ``doc_id`` teach nothing; a mean
of exactly one half counts as good; repeated rows give repeated results; texts of any length are read whole; further columns pass
through, but for one named ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.hashing import SPACED, Words, chunks

FEATURES = ("bytes", "words", "word_bytes", "upper", "digits", "spaces", "stops", "exclaims", "symbols", "quotes", "other_scripts", "distinct", "repeats", "capitals", "marked_words", "ends", "same_line")
QUANTILES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
NONE = len(QUANTILES) + 1  # the bin of a neighbour that isn't there
_SYMBOL, _LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _EXCLAIM, _QUOTE, _OTHER = range(9)


def _classes() -> np.ndarray:
    t = np.full(256, _SYMBOL, np.int64)
    t[0x61:0x7B], t[0x41:0x5B], t[0x30:0x3A], t[0x80:] = _LOWER, _UPPER, _DIGIT, _OTHER
    t[~SPACED] = _SPACE
    for signs, kind in ((b".,;:", _STOP), (b"!?", _EXCLAIM), (b"\"'()-", _QUOTE)):
        t[list(signs)] = kind
    return t


_CLASS = _classes()


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3 is 1; false for null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts: the features of every line with a word, its bytes, and where each text's lines begin (and end)."""
    bounds = np.union1d(offsets, np.flatnonzero(data == 0x0A) + 1)
    found = Words(data, bounds, SPACED)
    keep = np.flatnonzero(found.counts)
    size, n = np.diff(bounds)[keep], found.counts[keep]
    first = found.first[:-1][keep]
    doc = np.searchsorted(offsets, bounds[:-1][keep], side="right") - 1
    at = np.searchsorted(doc, np.arange(len(offsets)))
    x = np.zeros((len(keep), len(FEATURES)), np.float32)
    if not len(keep):
        return x, size, at
    kinds = _CLASS[data]
    line = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    count = np.bincount(line * 9 + kinds, minlength=9 * (len(bounds) - 1)).reshape(-1, 9)[keep]
    hashes = found.hashes(data)
    of = np.repeat(np.arange(len(keep)), n)  # the line of each word, since lines without words have none
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    symbols = np.concatenate([[0], np.cumsum(kinds == _SYMBOL)])
    marked = symbols[found.ends] > symbols[found.starts]
    capital = kinds[found.starts] == _UPPER
    mark = lambda flags: np.add.reduceat(flags.astype(np.float32), first) / n
    sums = np.add.reduceat(hashes, first)
    same = np.zeros(len(keep), bool)
    same[1:] = (sums[1:] == sums[:-1]) & (n[1:] == n[:-1]) & (doc[1:] == doc[:-1])
    letters = count[:, _LOWER] + count[:, _UPPER] + 1
    last = kinds[found.ends[first + n - 1] - 1]
    columns = {
        "bytes": np.log1p(size), "words": np.log1p(n), "word_bytes": (size - count[:, _SPACE]) / n, "upper": count[:, _UPPER] / letters, "digits": count[:, _DIGIT] / size, "spaces": count[:, _SPACE] / size,
        "stops": count[:, _STOP] / n, "exclaims": count[:, _EXCLAIM] / n, "symbols": count[:, _SYMBOL] / n, "quotes": count[:, _QUOTE] / n, "other_scripts": count[:, _OTHER] / size,
        "distinct": np.bincount(of[order][new], minlength=len(keep)) / n, "repeats": mark(again), "capitals": mark(capital), "marked_words": mark(marked), "ends": (last == _STOP) + 2.0 * (last == _EXCLAIM), "same_line": same,
    }
    for k, name in enumerate(FEATURES):
        x[:, k] = columns[name]
    return x, size, at


def _binned(x: np.ndarray, edges: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of indexes into the flat weights: bins of the line, of the one before, of the one after."""
    n, k = x.shape
    own = np.empty((n, k), np.int64)
    for j in range(k):
        own[:, j] = np.searchsorted(edges[j], x[:, j], side="left")
    before, after = np.full((n, k), NONE), np.full((n, k), NONE)
    before[1:], after[:-1] = own[:-1], own[1:]
    begins, ends = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0] - 1
    before[begins], after[ends] = NONE, NONE
    base = np.arange(k) * (NONE + 1)
    return np.concatenate([own + base, before + base + k * (NONE + 1), after + base + 2 * k * (NONE + 1)], axis=1)


def messages(evidence: np.ndarray, at: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios good to bad of the forward and backward messages of every line; ``move[i, j]`` scores going from i to j, 1 is good."""
    order = np.argsort(-np.diff(at), kind="stable")
    first, n = at[:-1][order], np.diff(at)[order]
    forward, backward = evidence.copy(), np.zeros(len(evidence))
    for t in range(1, int(n[0]) if len(n) else 0):  # texts with a t-th line are a prefix
        i = first[: np.searchsorted(-n, -t, side="left")] + t
        r = forward[i - 1]
        forward[i] += np.logaddexp(r + move[1, 1], move[0, 1]) - np.logaddexp(r + move[1, 0], move[0, 0])
        i = (first + n)[: len(i)] - 1 - t
        b = evidence[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(b + move[1, 1], move[1, 0]) - np.logaddexp(b + move[0, 1], move[0, 0])
    return forward, backward


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _mean(p: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of ``p`` by ``size`` for each text; nan for a text without lines."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    total = np.bincount(doc, weights=size, minlength=len(at) - 1)
    with np.errstate(invalid="ignore"):
        return np.bincount(doc, weights=p * size, minlength=len(at) - 1) / total


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # features x quantiles
    weights: np.ndarray  # (own, before, after) x features x bins, flat
    bias: float
    move: np.ndarray
    slope: float
    shift: float
    share: float  # of good labels: the score of texts without words

    def marginals(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's probability of being good, its bytes, and where each text's lines begin."""
        x, size, at = lines(data, offsets)
        if not len(self.weights):
            return np.full(len(x), self.share), size, at
        evidence = self.bias + self.weights[_binned(x, self.edges, at)].sum(1)
        forward, backward = messages(evidence, at, self.move)
        return _sigmoid(forward + backward), size, at

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(offsets) - 1, self.share)
        mean = _mean(*self.marginals(data, offsets))
        return np.where(np.isnan(mean), self.share, _sigmoid(self.slope * mean + self.shift))


def _draw(share: float) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_003)) / 1_000_003 < share


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 2500, max_bytes: int = 24 << 20, steps: int = 120, rate: float = 0.08, decay: float = 2e-3) -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, quality)``."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"))
    n = marks.agg(F.count("*").alias("all"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    share = n["good"] / n["all"] if n["all"] else 0.5
    if share in (0, 1) or not n["all"]:
        return Model(np.zeros((len(FEATURES), 0)), np.zeros(0), 0.0, np.zeros((2, 2)), 0.0, 0.0, float(share))
    weight = F.octet_length("text") + 72 * F.regexp_count("text", F.lit("\n"))
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", weight.alias("weight")).filter(F.col("weight") < max_bytes // 64)
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("weight"), F.lit(0)).alias("bytes")).first()
    most = min(max_train, max_bytes / 2 / max(size["bytes"] / max(size["rows"], 1), 1))
    chosen = marks.filter(F.when(F.col("good") == 1, _draw(most / n["good"])).otherwise(_draw(most / (n["all"] - n["good"]))))  # about 2 * most ids

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch):
                x, size, at = lines(data, offsets)
                flat = pa.array(x.reshape(-1), pa.float32())
                cut = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("good").slice(a, b - a), cut(pa.array(size.astype(np.int64)), at), cut(flat, at * len(FEATURES))], names=["doc_id", "good", "size", "x"])

    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "good").mapInArrow(measured, "doc_id long, good int, size array<long>, x array<float>").toArrow()
    return _train(found.sort_by("doc_id"), float(share), steps, rate, decay)


def _adam(evaluate, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = evaluate(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _train(found: pa.Table, share: float, steps: int, rate: float, decay: float) -> Model:
    good = found.column("good").to_numpy().astype(float)
    sizes = found.column("size").combine_chunks()
    at, size = np.asarray(sizes.offsets.to_numpy()), sizes.flatten().to_numpy().astype(float)
    at = at - at[0] if len(at) else np.zeros(1, int)
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    if not len(x) or good.min() == good.max():
        return Model(np.zeros((len(FEATURES), 0)), np.zeros(0), 0.0, np.zeros((2, 2)), 0.0, 0.0, share)
    edges = np.quantile(x, QUANTILES, axis=0).T.astype(np.float32)
    bins = _binned(x, edges, at)
    doc = np.repeat(np.arange(len(good)), np.diff(at))
    n_weights = 3 * len(FEATURES) * (NONE + 1)
    per_line = 1 / np.maximum(np.diff(at), 1)[doc]  # a document counts once, however many lines it has
    per_line /= per_line.sum()

    def of_weights(error: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(bins.ravel(), weights=np.repeat(error, bins.shape[1]), minlength=n_weights) + decay * w[:n_weights], error.sum())

    def alone(w: np.ndarray) -> np.ndarray:
        return of_weights((_sigmoid(w[bins].sum(1) + w[n_weights]) - label) * per_line, w)

    label = good[doc]
    w = _adam(alone, n_weights + 1, steps, rate)
    p = _sigmoid(w[bins].sum(1) + w[n_weights])
    worst = np.full(len(good), 2.0)
    np.minimum.at(worst, doc, p)
    label = np.where((label == 0) & (p > 0.5) & (p > worst[doc]), 1.0, label)
    follows = np.ones(len(label), bool)
    follows[at[:-1][np.diff(at) > 0]] = False
    j = np.flatnonzero(follows)
    y = label.astype(int)
    seen = np.bincount(2 * y[j - 1] + y[j], weights=per_line[j], minlength=4).reshape(2, 2)

    def chained(w: np.ndarray) -> np.ndarray:
        move = w[n_weights + 1 :].reshape(2, 2)
        evidence = w[bins].sum(1) + w[n_weights]
        forward, backward = messages(evidence, at, move)
        after = evidence[j] + backward[j]
        z = np.stack([np.zeros(len(j)) + move[0, 0], after + move[0, 1], forward[j - 1] + move[1, 0], forward[j - 1] + after + move[1, 1]])
        z = np.exp(z - z.max(0))
        expected = (z / z.sum(0) * per_line[j]).sum(1)
        error = (_sigmoid(forward + backward) - label) * per_line
        return np.concatenate([of_weights(error, w), expected - seen.ravel() + decay * w[n_weights + 1 :]])

    w = _adam(chained, n_weights + 5, steps, rate)
    move = w[n_weights + 1 :].reshape(2, 2)
    forward, backward = messages(w[bins].sum(1) + w[n_weights], at, move)
    mean = _mean(_sigmoid(forward + backward), size, at)
    has = ~np.isnan(mean)
    each = np.where(good == 1, share / good.mean(), (1 - share) / (1 - good.mean()))[has]  # the sample has as many of both classes, the labels have not
    each /= each.sum()

    def calibrated(c: np.ndarray) -> np.ndarray:
        error = (_sigmoid(c[0] * mean[has] + c[1]) - good[has]) * each
        return np.array([(error * mean[has]).sum() + 1e-4 * c[0], error.sum()])

    slope, shift = _adam(calibrated, 2, 1500, 0.1)
    return Model(edges, w[:n_weights], float(w[n_weights]), move, float(slope), float(shift), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but a clashing one, with ``score``."""
    kept = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(data, offsets))], names=[*part.schema.names, "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, line, n_bytes, p_good, good`` of every line with a word, numbered from 0 among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch):
                p, size, at = model.marginals(data, offsets)
                doc = np.repeat(np.arange(b - a), np.diff(at))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(doc)), pa.array((np.arange(len(p)) - at[:-1][doc]).astype(np.int32)), pa.array(size.astype(np.int64)), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "line", "n_bytes", "p_good", "good"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line int, n_bytes long, p_good double, good boolean")
