"""Runs of equal states: latches, streaks, segments, transitions.  All are window functions over ``idx``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numeric import C, col, ratio
from tidemark.operators.rolling import series, so_far

U = "universe"


def latch(x: C, on: float, off: float, w: WindowSpec) -> Column:
    """1 from ``x >= on``, -1 from ``x <= off``, otherwise what it was; 0 at first."""
    set_ = F.when(col(x) >= on, 1).when(col(x) <= off, -1)
    return F.coalesce(F.last(set_, ignorenulls=True).over(so_far(w)), F.lit(0))


def executed(state: C, w: WindowSpec, delay: int = 1) -> Column:
    return F.coalesce(F.lag(col(state), delay).over(w), F.lit(0)) if delay else col(state)


def with_streak(df: DataFrame, holds: Column, out: str, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``out``: for how many rows, this one included, ``holds`` has been true."""
    w = series(*by)
    d = df.withColumn("__hold", F.coalesce(holds, F.lit(False)))
    d = d.withColumn("__island", F.sum(F.when(F.col("__hold"), 0).otherwise(1)).over(so_far(w)))
    run = series(*by, "__island")
    return d.withColumn(out, F.sum(F.col("__hold").cast("int")).over(so_far(run)).cast("int")).drop("__hold", "__island")


def with_segment(df: DataFrame, state: str, by: tuple[str, ...] = (U,), out: str = "segment") -> DataFrame:
    w = series(*by)
    changed = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & F.lag("idx").over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn(out, F.sum("__changed").over(so_far(w))).drop("__changed")


def segments(df: DataFrame, state: str, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``segment, state, start_d, end_d, n`` of every run of one state."""
    return with_segment(df, state, by).groupBy(*by, "segment").agg(F.first(state).alias(state), F.min("d").alias("start_d"), F.max("d").alias("end_d"), F.count("*").alias("n"))


def transitions(df: DataFrame, state: str, price: str, by: tuple[str, ...] = (U,), limit: int | None = 10) -> DataFrame:
    """Changes of state, newest first (``rank`` 1): from, to, when, price then and at the next change or the end.

    ``hit``: the price moved with the state; a neutral state hits when it did not fall.
    """
    w = series(*by)
    runs = with_segment(df, state, by).groupBy(*by, "segment").agg(
        F.first(state).alias("state"), F.min("d").alias("d"), F.min_by(price, "idx").alias("price_start"), F.max_by(price, "idx").alias("last_price"), F.max("d").alias("last_d"),
    )
    n = series(*by, order="segment")
    full = runs.select(*by, "segment", "state", "d", "price_start", F.lag("state").over(n).alias("prev_state"), F.coalesce(F.lead("d").over(n), F.col("last_d")).alias("end_d"), F.coalesce(F.lead("price_start").over(n), F.col("last_price")).alias("price_end"))
    move = ratio("price_end", "price_start") - 1
    full = full.filter("prev_state is not null").withColumns({"price_delta": F.col("price_end") - F.col("price_start"), "return_pct": move * 100})
    full = full.withColumn("hit", F.when(F.col("state") > 0, F.col("return_pct") > 0).when(F.col("state") < 0, F.col("return_pct") < 0).otherwise(F.col("return_pct") >= 0))
    newest = series(*by, order="segment").orderBy(F.desc("segment"))
    ranked = full.withColumn("rank", F.row_number().over(newest))
    return (ranked.filter(F.col("rank") <= limit) if limit else ranked).drop("segment")
