"""Operators whose rows depend on their own past: exponential means, countdowns, caps, pivots.

Each is one grouped pandas pass over a series in ``idx`` order, so series run in parallel.  A series is
bounded by its calendar (a day a row); rows of many series never meet in one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.functions.numeric import clamp, clamp_levered, finite
from tidemark.operators.rolling import log_return, series, simple_return, so_far

U = "universe"


def per_series(df: DataFrame, fold, out: dict[str, str], by: tuple[str, ...] = (U,), using: tuple[str, ...] | None = None) -> DataFrame:
    """``fold(rows in idx order) -> {column: values}`` for each series; nan becomes NULL.

    The fold sees the columns ``using`` (all, if not given) as pandas; the others pass by as they are.
    """
    kinds = {"double": DoubleType(), "int": IntegerType()}
    arrow = {"double": pa.float64(), "int": pa.int32()}
    kept = df.drop(*out)
    schema = StructType([*kept.schema.fields, *(StructField(c, kinds[t]) for c, t in out.items())])
    names, seen = kept.columns, list(df.columns if using is None else using)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("idx")))
        found = fold(table.select(seen).to_pandas())
        new = [pa.array(np.asarray(found[c], float), from_pandas=True).cast(arrow[t]) if t == "double" else pa.array(np.asarray(found[c]), arrow[t]) for c, t in out.items()]
        return pa.Table.from_arrays([*(table.column(c) for c in names), *new], names=[*names, *out])

    return df.groupBy(*by).applyInArrow(run, schema)


def ema_values(x: pd.Series, n: int) -> pd.Series:
    """k = 2 / (n + 1), seeded with the first value; missing values are passed over."""
    return x.ewm(span=n, adjust=False, ignore_na=True).mean()


def mad_values(x: pd.Series, n: int, least: int = 5) -> np.ndarray:
    """As ``rolling.mad_sigma`` for a whole series at once: frames of the last ``n`` rows, missing values left out."""
    from tidemark.operators.order import deviations

    return deviations(x.to_numpy(float), n, least)


def upper_mad_values(x: pd.Series, n: int, least: int = 5) -> np.ndarray:
    """As ``mad_values`` with the upper of the two middle values for a median."""
    from tidemark.operators.order import deviations

    return deviations(x.to_numpy(float), n, least, upper=True)


def with_ema(df: DataFrame, spec: dict[str, tuple[str, int]], by: tuple[str, ...] = (U,)) -> DataFrame:
    """``spec``: {new column: (column, span)}; all in one pass."""
    return per_series(df, lambda p: {c: ema_values(p[x].astype(float), n) for c, (x, n) in spec.items()}, dict.fromkeys(spec, "double"), by, tuple({x for x, _ in spec.values()}))


def bear_damp(panel: DataFrame, symbols: tuple[str, ...] = ("QQQ", "IWM", "BTC-USD"), span: int = 60) -> DataFrame:
    """``idx, d, damp``: 1 / (1 + .5 max(0, R - 1.2)), at least .5.

    R is the worst symbol's ratio of exponential means of squared losses and squared gains, at most 5;
    1 on the first day, which has no return.
    """
    w = series(U, "symbol")
    r = panel.filter(F.col("symbol").isin(*symbols)).withColumn("r", log_return("close", w))
    known = F.col("r").isNotNull()
    r = r.withColumns({"up": F.when(known, F.pow(F.greatest("r", F.lit(0.0)), 2)), "down": F.when(known, F.pow(F.greatest(-F.col("r"), F.lit(0.0)), 2))})
    e = with_ema(r.select(U, "symbol", "idx", "d", "up", "down"), {"e_up": ("up", span), "e_down": ("down", span)}, (U, "symbol"))
    worst = e.groupBy(U, "idx", "d").agg(F.max(clamp(finite(F.col("e_down") / (F.col("e_up") + 1e-12)), 0, 5)).alias("ratio"))
    return worst.withColumn("damp", F.greatest(F.lit(0.5), 1 / (1 + 0.5 * F.greatest(F.lit(0.0), F.coalesce("ratio", F.lit(1.0)) - 1.2))))


def held_cap(trigger: np.ndarray, recover: np.ndarray, hold: int) -> np.ndarray:
    """1 while a cap holds: ``hold`` rows from a trigger, cut to one row by a recovery."""
    out, left = np.zeros(len(trigger), np.int32), 0
    for i, (t, r) in enumerate(zip(trigger, recover)):
        left = max(left, hold) if t else left
        left = min(left, 1) if r else left
        out[i] = left > 0
        left = max(left - 1, 0)
    return out


def countdowns(lead: np.ndarray, fall: np.ndarray, hazard: np.ndarray, n_lead: int, n_grace: int, n_hazard: int) -> dict[str, np.ndarray]:
    """Rows left of an up-lead, of the grace after a fall, and of a hazard, which only runs down after the grace."""
    up = grace = danger = 0
    out = np.zeros((len(lead), 3), np.int32)
    for i in range(len(lead)):
        up = n_lead if lead[i] else max(up - 1, 0)
        grace = n_grace if fall[i] else max(grace - 1, 0)
        danger = n_hazard if hazard[i] else danger if grace else max(danger - 1, 0)
        out[i] = up, grace, danger
    return {"up_lead": out[:, 0], "grace": out[:, 1], "hazard": out[:, 2]}


def opened(lead: np.ndarray, fall: np.ndarray, up_lead: int, grace: int, hazard: int) -> dict[str, np.ndarray]:
    """1 on the rows of a lead, and on those of a hazard, whose rows begin when the grace of the fall is used up."""
    left = [0, 0, 0]
    out = np.zeros((len(lead), 2), np.int32)
    for i in range(len(lead)):
        if lead[i]:
            left[0] = max(left[0], up_lead)
        if fall[i]:
            left[1:] = max(left[1], grace), max(left[2], hazard)
        if left[0]:
            out[i, 0], left[0] = 1, left[0] - 1
        if left[1]:
            left[1] -= 1
        elif left[2]:
            out[i, 1], left[2] = 1, left[2] - 1
    return {"up_lead": out[:, 0], "hazard": out[:, 1]}


def pivots(df: DataFrame, x: str, by: tuple[str, ...] = (U,)) -> DataFrame:
    """Strict five-point peaks (1) and troughs (-1) of ``x`` with the gap in rows since the one before of its kind."""
    w = series(*by)
    around = [F.lag(x, k).over(w) for k in (2, 1)] + [F.lead(x, k).over(w) for k in (1, 2)]
    top = bottom = F.lit(True)
    for a in around:
        top, bottom = top & (F.col(x) > a), bottom & (F.col(x) < a)
    found = df.withColumn("pivot", F.when(top, 1).when(bottom, -1)).filter("pivot is not null")
    return found.withColumn("gap", F.col("idx") - F.lag("idx").over(series(*by, "pivot")))


def cycle(pivot_rows: DataFrame, by: tuple[str, ...] = (U,), low: int = 10, high: int = 60) -> DataFrame:
    """Cycle length of a series: twice the upper median gap of its pivots, within bounds."""
    gaps = pivot_rows.filter("gap is not null").groupBy(*by).agg(F.sort_array(F.collect_list("gap")).alias("g"))
    middle = F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1)
    return gaps.select(*by, (2 * F.least(F.greatest(middle, F.lit(low // 2)), F.lit(high // 2))).cast("long").alias("cycle"), F.size("g").cast("long").alias("n_gaps"))


def synthetic_levered(panel: DataFrame, base: str = "QQQ", leverage: float = 3.0) -> DataFrame:
    """``idx, d, close, levered, log_levered``: first price of the base, compounded by clamped levered returns."""
    w = series(U)
    r = panel.filter(F.col("symbol") == base).withColumn("lr", clamp_levered(simple_return("close", w) * leverage))
    total = F.ln(F.first("close").over(so_far(w))) + F.sum(F.ln(1 + F.coalesce("lr", F.lit(0.0)))).over(so_far(w))
    return r.withColumn("log_levered", total).select(U, "idx", "d", "close", F.exp("log_levered").alias("levered"), "log_levered")
