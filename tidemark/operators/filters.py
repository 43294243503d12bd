"""Projections and guards over series: normalised prices, winsorised values, lengths, freshness, resolution of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rolling import series, so_far

U = "universe"


def normalized(panel: DataFrame, by: tuple[str, ...] = (U, "symbol")) -> DataFrame:
    """With ``norm``: close over the first close that is known and not 0."""
    first = F.first(F.when(F.col("close") != 0, F.col("close")), ignorenulls=True).over(so_far(series(*by, order="d")))
    return panel.withColumn("norm", F.try_divide("close", first))


def winsorized(rows: DataFrame, x: str, share: float, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``x`` within its own quantiles ``share`` and ``1 - share``; one aggregation and a join with one row a group."""
    q = rows.groupBy(*by).agg(F.percentile(x, [share, 1 - share]).alias("__q"))
    return rows.join(q, list(by)).withColumn(x, F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("__q")[0]), F.col("__q")[1]))).drop("__q")


def quartile_scaled(rows: DataFrame, x: str, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``x`` less its median over its interquartile range; NULL where that is 0."""
    q = rows.groupBy(*by).agg(F.percentile(x, [0.25, 0.5, 0.75]).alias("__q"))
    return rows.join(q, list(by)).withColumn(x, F.try_divide(F.col(x) - F.col("__q")[1], F.col("__q")[2] - F.col("__q")[0])).drop("__q")


def right_aligned(days: DataFrame, values: DataFrame, value: str, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``days`` with ``values`` put against their end: the last value on the last day; the rest is NULL."""
    back = Window.partitionBy(*by).orderBy(F.desc("idx"))
    d = days.withColumn("__n", F.row_number().over(back))
    v = values.withColumn("__n", F.row_number().over(back)).select(*by, "__n", value)
    return d.join(v, [*by, "__n"], "left").drop("__n")


def effective_days(rows: DataFrame, today: Column, intraday: bool) -> DataFrame:
    """Without days after ``today`` and, outside trading hours, without today's stub."""
    return rows.filter(F.col("d") <= today) if intraday else rows.filter(F.col("d") < today)


def coverage(panel: DataFrame, start: Column, end: Column, most_age: int = 3) -> DataFrame:
    """Per universe: first and last day, whether they cover the range, and whether the last is stale at ``end``."""
    g = panel.groupBy(U).agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    return g.withColumns({"covers": (F.col("first_d") <= start) & (F.col("last_d") >= end), "stale": F.datediff(end, "last_d") > most_age})


def shifted_days(rows: DataFrame, today: Column, most_age: int = 7) -> DataFrame:
    """Display only: all days moved so that the newest is ``today`` if it is older than ``most_age`` days."""
    newest = F.max("d").over(Window.partitionBy(U))
    late = F.datediff(today, newest)
    return rows.withColumn("d", F.when(late > most_age, F.date_add("d", late)).otherwise(F.col("d")))


def first_states(rows: DataFrame) -> DataFrame:
    """One sign-normalised state a day: that of the day's first row."""
    return rows.groupBy(U, "d").agg(F.min_by(F.signum("state").cast("int"), "idx").alias("state"))


def complete_lookup(days: DataFrame, states: DataFrame) -> DataFrame:
    """``days`` with ``state``; no rows at all for a universe that misses any day."""
    met = days.join(states.select(U, "d", "state"), [U, "d"], "left")
    gaps = F.sum(F.col("state").isNull().cast("int")).over(Window.partitionBy(U))
    return met.withColumn("__gaps", gaps).filter("__gaps = 0").drop("__gaps")


def directional_index(rows: DataFrame, n: int = 14) -> DataFrame:
    """DI+ and DI- from closes alone: exponential means of gains and losses over that of absolute moves."""
    from tidemark.operators.folds import with_ema

    step = F.col("close") - F.lag("close").over(series(U))
    d = rows.withColumns({"__up": F.greatest(step, F.lit(0.0)), "__down": F.greatest(-step, F.lit(0.0)), "__move": F.abs(step)})
    d = d.withColumns({c: F.when(step.isNotNull(), F.col(c)) for c in ("__up", "__down")})
    e = with_ema(d, {"__eu": ("__up", n), "__ed": ("__down", n), "__em": ("__move", n)})
    share = lambda c: 100 * F.try_divide(F.nanvl(c, F.lit(None)), F.nanvl("__em", F.lit(None)))
    return e.withColumns({"di_plus": share("__eu"), "di_minus": share("__ed")}).drop("__up", "__down", "__move", "__eu", "__ed", "__em")
