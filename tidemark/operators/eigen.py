"""Eigen operators on small correlation matrices, one batched numpy call per Arrow batch.

A matrix comes as the array of its upper triangle, row by row.  Signs are fixed so that the components
of an eigenvector don't sum to less than 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import SYMBOLS, pairs
from tidemark.functions.numeric import C, col


def _matrices(upper: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(index of the usable rows, their matrices)."""
    usable = [i for i, u in enumerate(upper) if u is not None and len(u) and not np.isnan(np.asarray(u, float)).any()]
    if not usable:
        return np.zeros(0, int), np.zeros((0, 1, 1))
    flat = np.stack([np.asarray(upper.iloc[i], float) for i in usable])
    n = int((1 + np.sqrt(1 + 8 * flat.shape[1])) / 2)
    m = np.tile(np.eye(n), (len(flat), 1, 1))
    i, j = np.triu_indices(n, 1)
    m[:, i, j] = m[:, j, i] = flat
    return np.array(usable), m


def absorption(upper: C) -> Column:
    """Share of the variance that the first component holds."""

    @F.pandas_udf("double")
    def run(u: pd.Series) -> pd.Series:
        at, m = _matrices(u)
        out = pd.Series(np.nan, range(len(u)), dtype="object")
        if len(at):
            out.iloc[at] = np.linalg.eigvalsh(m)[:, -1] / m.shape[1]
        return out.where(out.notna(), None).astype("float64")

    return F.when(col(upper).isNotNull(), run(col(upper)))


def first_component(upper: C) -> Column:
    """Unit eigenvector of the largest eigenvalue."""

    @F.pandas_udf("array<double>")
    def run(u: pd.Series) -> pd.Series:
        at, m = _matrices(u)
        out = pd.Series([None] * len(u), dtype="object")
        if len(at):
            v = np.linalg.eigh(m)[1][:, :, -1]
            v *= np.where(v.sum(1, keepdims=True) < 0, -1, 1)
            for i, x in zip(at, v):
                out.iloc[i] = x
        return out

    return run(col(upper))


def upper_triangles(corr: DataFrame, symbols: tuple[str, ...] = SYMBOLS, value: str = "corr") -> DataFrame:
    """``universe, idx, d, upper``: the pair values of a day in universe order; NULL if one is missing."""
    order = {frozenset(p): i for i, p in enumerate(pairs(symbols))}
    place = F.create_map(*(x for p, i in order.items() for a, b in (sorted(p), sorted(p)[::-1]) for x in (F.lit(f"{a}|{b}"), F.lit(i))))
    rows = corr.filter(F.col("s1").isin(*symbols) & F.col("s2").isin(*symbols)).withColumn("__at", F.element_at(place, F.concat_ws("|", "s1", "s2")))
    held = rows.groupBy("universe", "idx", "d").agg(F.array_sort(F.collect_list(F.struct("__at", value))).alias("__u"))
    return held.select("universe", "idx", "d", F.when(F.size("__u") == len(order), F.transform("__u", lambda x: x[value])).alias("upper"))


def frobenius_change(corr: DataFrame, n_symbols: int) -> DataFrame:
    """``universe, idx, d, frob``: root mean square change of all matrix cells since the row before."""
    from tidemark.operators.rolling import series

    step = corr.withColumn("__c", F.col("corr") - F.lag("corr").over(series("universe", "s1", "s2")))
    return step.groupBy("universe", "idx", "d").agg(F.sqrt(2 * F.sum(F.pow("__c", 2)) / (n_symbols * n_symbols)).alias("frob"))
