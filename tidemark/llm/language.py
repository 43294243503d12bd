"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword of bits; one linear classifier over hashed byte n-grams predicts each
bit, and the codeword with the least logistic loss wins.  A document is flagged ambiguous when the
second codeword is nearly as close.

Fitting uses a bounded sample: about ``max_train`` documents, spread evenly over the languages (a
language's documents are taken by a hash of ``doc_id`` below a share counted over all rows).  Scoring
reads every byte of every text and needs no shuffle.

Defined cases: null text, empty text and text without a letter give ``und`` with score 0 and are not
ambiguous; with no labelled rows at all every document is ``und``; equal losses go to the language first
in alphabetical order; null ``lang`` is unlabelled; rows with null ``doc_id`` are scored but not learned
from; repeated rows give repeated results; very long texts are read whole; further columns pass through, but for those
named as the three of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.hashing import LETTERED, LOWER, chunks

BUCKETS, ORDERS = 1 << 12, (2, 3, 4)
_LETTER = "language: has a letter"
#: Bytes of text taken apart at once; results are of each document, its arrays are in every worker.
CHUNK = 1 << 18


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: Column | str = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


def _letters() -> np.ndarray:
    t = LOWER.copy()
    t[~LETTERED] = t[0x30:0x3A] = 0x20
    return t


_TABLE = _letters()


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, where each document's begin) for every order; n-grams stay within a document."""
    x = _TABLE[data].astype(np.uint32)
    for n in ORDERS:
        code = np.full(max(len(x) - n + 1, 0), n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ x[k : len(x) - n + 1 + k]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(13)
        ends = np.maximum(offsets[1:] - n + 1, offsets[:-1])
        keep = np.ones(len(code), bool)
        for k in range(1, n):
            last = offsets[1:] - k
            keep[last[(last >= 0) & (last < len(code))]] = False
        per_doc = ends - offsets[:-1]
        yield (code[keep] & np.uint32(BUCKETS - 1)).astype(np.int64), np.concatenate([[0], np.cumsum(per_doc)])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # bits x (orders * buckets)
    bias: np.ndarray
    margin: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, ambiguous) of each document of a chunk."""
        z = np.tile(self.bias, (len(offsets) - 1, 1))
        for k, (bucket, at) in enumerate(_grams(data, offsets)):
            n = np.maximum(np.diff(at), 1)
            for b, w in enumerate(self.weights[:, k * BUCKETS : (k + 1) * BUCKETS]):
                z[:, b] += _sums(w[bucket], at) / n
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None]).sum(2)
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        score = p.max(1) / p.sum(1)
        near = np.sort(loss, 1)
        return best, score, (near[:, 1] - near[:, 0] < self.margin) if loss.shape[1] > 1 else np.zeros(len(best), bool)


def codewords(n: int) -> np.ndarray:
    """A code of +1 and -1 for ``n`` classes: every split for few classes, else the best of 200 random codes."""
    if n <= 5:
        rows = np.arange(2 ** max(n - 1, 0) - 1) if n > 1 else np.zeros(1, int)
        bits = [[1] * len(rows)] + [list((rows >> k & 1) * 2 - 1) for k in range(n - 1)]
        return np.array(bits[:n], float)
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        d = (c.shape[1] - c @ c.T) / 2 + np.eye(n) * c.shape[1]
        if d.min() > far and (abs(c.sum(0)) < n).all():
            best, far = c, d.min()
    return best


def fit(labelled: DataFrame, max_train: int = 4000, steps: int = 150, rate: float = 1.0, decay: float = 1e-4, margin: float = 1.0) -> Model | None:
    """Fit on ``labelled(doc_id, text, lang)``; null where no row has a language and a letter."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    languages = tuple(sorted(counts))
    most = max(max_train // len(languages), 1)
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, most / counts[lang])))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = rows.filter(draw < share[F.col("lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch, most=CHUNK):
                cols: list[list] = [[], []]
                grams = list(_grams(data, offsets))
                for i in range(b - a):
                    parts = [np.unique(g[at[i] : at[i + 1]], return_counts=True) for g, at in grams]
                    cols[0].append(np.concatenate([u + k * BUCKETS for k, (u, _) in enumerate(parts)]).astype(np.int16))
                    cols[1].append(np.concatenate([c / c.sum() for _, c in parts]).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array(cols[0], pa.list_(pa.int16())), pa.array(cols[1], pa.list_(pa.float32()))], names=["lang", "bucket", "share"])

    found = sample.mapInArrow(features, "lang string, bucket array<smallint>, share array<float>").toArrow()
    return _train(found, languages, steps, rate, decay, margin)


def _train(found: pa.Table, languages: tuple[str, ...], steps: int, rate: float, decay: float, margin: float) -> Model:
    """Logistic regression of all bits at once; every language weighs the same.

    Documents are made dense 500 at a time, so the driver never holds the whole matrix.
    """
    d, parts = BUCKETS * len(ORDERS), []
    for batch in found.to_batches():
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            row = np.repeat(np.arange(part.num_rows, dtype=np.int16), np.diff(part.column("bucket").offsets.to_numpy()))
            lang = np.array([languages.index(x) for x in part.column("lang").to_pylist()], int)
            parts.append([row, part.column("bucket").flatten().to_numpy(), part.column("share").flatten().to_numpy(), lang])
    n = np.zeros(len(languages))
    total = np.zeros(d)
    for _, bucket, share, lang in parts:
        total += np.bincount(bucket, weights=share, minlength=d)
        n += np.bincount(lang, minlength=len(languages))
    scale = (1 / np.sqrt(total / max(n.sum(), 1) + 1e-4)).astype(np.float32)
    for part in parts:
        part[2] = part[2] * scale[part[1]]
    code, even = codewords(len(languages)), 1 / np.maximum(n, 1) / max((n > 0).sum(), 1)
    w, bias, speed = np.zeros((d, code.shape[1]), np.float32), np.zeros(code.shape[1]), 0
    held = np.zeros((500, d), np.float32)
    for _ in range(steps):
        down, down_bias = np.zeros_like(w), np.zeros(code.shape[1])
        for row, bucket, share, lang in parts:
            x, y = held[: len(lang)], code[lang]
            x.fill(0)
            x[row, bucket] = share
            g = -y * even[lang][:, None] / (1 + np.exp(np.clip(y * (x @ w + bias), -60, 60)))
            down += x.T @ g.astype(np.float32)
            down_bias += g.sum(0)
        speed = 0.9 * speed + down + decay * w
        w -= rate * speed
        bias -= rate * 0.1 * down_bias
    return Model(languages, code, (w * scale[:, None]).T.astype(np.float64).copy(), bias, margin)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` but clashing ones, with ``lang_pred, score, ambiguous``."""
    if model is None:
        return docs.drop("lang_pred", "score", "ambiguous").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(False)})
    mine = docs.drop("lang_pred", "score", "ambiguous")
    passed, names = mine.columns, pa.array([*model.languages, "und"])
    kept = mine.withColumn(_LETTER, has_letter())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch, most=CHUNK):
                part = batch.slice(a, b - a)
                best, score, near = model.predict(data, offsets)
                ok = part.column(_LETTER).to_numpy(zero_copy_only=False)
                cols = [part.column(c) for c in passed]
                cols += [names.take(pa.array(np.where(ok, best, len(names) - 1))), pa.array(np.where(ok, score, 0.0)), pa.array(near & ok)]
                yield pa.RecordBatch.from_arrays(cols, names=[*passed, "lang_pred", "score", "ambiguous"])

    schema = StructType(mine.schema.fields).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return kept.mapInArrow(run, schema)
