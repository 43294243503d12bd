"""Backtests: a state series and prices to returns, equity and statistics.

A decision of row ``t`` is executed ``delay`` rows later.  All of it is window functions of one
universe (or one parameter set), so many of them run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import YEAR, Execution
from tidemark.functions.numeric import levered_return, ratio
from tidemark.operators.islands import executed
from tidemark.operators.rolling import compounded, drawdown, series, simple_return

U = "universe"


def exposure(state: str | Column, e: Execution) -> Column:
    """What a state holds, as a multiple of the asset."""
    s = F.col(state) if isinstance(state, str) else state
    return F.when(s > 0, e.leverage).when(s < 0, 0.0).otherwise(e.neutral_weight * e.neutral_leverage)


def backtest(signal: DataFrame, e: Execution = Execution(), by: tuple[str, ...] = (U,)) -> DataFrame:
    """``signal(by, idx, d, state, open, close)`` with ``executed, ret, ret_strategy, equity, equity_bench, dd``.

    open_close: the return of the executed day from its open; open_open: from its open to the next
    row's; open_before: from the open before to its own; close_close: from the close before.  A missing return
    counts as 0.
    """
    w = series(*by)
    opened = F.coalesce("open", "close")
    r = {
        "open_close": ratio("close", opened) - 1,
        "open_open": ratio(F.lead(opened).over(w), opened) - 1,
        "open_before": ratio(opened, F.lag(opened).over(w)) - 1,
        "close_close": simple_return("close", w),
    }[e.price]
    d = signal.withColumns({"executed": executed("state", w, e.delay), "ret": F.coalesce(r, F.lit(0.0))})
    d = d.withColumn("ret_strategy", levered_return("ret", exposure("executed", e), floor=e.floor))
    d = d.withColumns({"equity": compounded("ret_strategy", w), "equity_bench": compounded(F.greatest("ret", F.lit(e.floor)), w)})
    return d.withColumn("dd", drawdown("equity", w))


def statistics(tested: DataFrame, by: tuple[str, ...] = (U,)) -> DataFrame:
    """One row per universe: total and yearly return, drawdown, hit rates, time in each state, churn."""
    w = series(*by)
    d = tested.withColumn("__changed", (F.col("state") != F.lag("state").over(w)).cast("int"))
    n = F.count("*")
    final = F.max_by("equity", "idx")
    active = F.when(F.col("executed") != 0, F.when(F.col("executed") * F.col("ret") > 0, 1.0).otherwise(0.0))
    on = F.when(F.col("executed") > 0, F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    share = lambda s: F.avg((F.col("state") == s).cast("double"))
    return d.groupBy(*by).agg(
        n.alias("n"), F.ln(final).alias("log_equity"), F.ln(F.max_by("equity_bench", "idx")).alias("log_bench"),
        F.when(final > 0, F.exp(F.ln(final) * YEAR / n) - 1).otherwise(0.0).alias("cagr"), F.min("dd").alias("max_drawdown"),
        F.avg(active).alias("hit_rate"), F.avg(on).alias("on_hit_rate"), share(1).alias("share_on"), share(0).alias("share_neutral"), share(-1).alias("share_off"),
        (F.sum("__changed") * YEAR / n).alias("churn"), F.sum("__changed").alias("transitions"),
    )


def yearly(tested: DataFrame, by: tuple[str, ...] = (U,), equity: str = "equity") -> DataFrame:
    """``year, ret``: last equity of the year over the last one before it."""
    last = tested.groupBy(*by, F.year("d").alias("year")).agg(F.max_by(equity, "d").alias("last"))
    w = series(*by, order="year")
    return last.select(*by, "year", (ratio("last", F.coalesce(F.lag("last").over(w), F.lit(1.0))) - 1).alias("ret"))


def forward(tested: DataFrame, k: int = 5, by: tuple[str, ...] = (U,)) -> DataFrame:
    """With ``ret_k``, the compounded return of the next ``k`` rows, and ``hit_k``, whether the state had its sign."""
    w = series(*by).rowsBetween(1, k)
    d = tested.withColumn(f"ret_{k}", F.when(F.count("ret").over(w) == k, F.exp(F.sum(F.ln(1 + F.col("ret"))).over(w)) - 1))
    return d.withColumn(f"hit_{k}", F.when(F.col("state") != 0, F.col("state") * F.col(f"ret_{k}") > 0))


def asset_backtest(signal: DataFrame, price: str = "close", delay: int = 1, neutral: float = 0.33, on: float = 1.0, by: tuple[str, ...] = (U,)) -> DataFrame:
    """A state traded in another asset than the benchmark: ``equity, equity_bench, equity_asset`` and the next prices.

    ``signal`` has ``idx, d, state, open, close, asset_open, asset_close``; ``price`` is close or open, a missing open is the
    close.  On holds ``on`` of the asset, neutral ``neutral``, off cash; the last row's next price is its own.
    """
    w = series(*by)
    pick = lambda o, c: F.coalesce(o, c) if price == "open" else F.col(c)
    d = signal.withColumns({"__b": pick("open", "close"), "__a": pick("asset_open", "asset_close"), "executed": executed("state", w, delay)})
    d = d.withColumns({"ret": F.coalesce(simple_return("__b", w), F.lit(0.0)), "ret_asset": F.coalesce(simple_return("__a", w), F.lit(0.0))})
    d = d.withColumn("ret_strategy", F.when(F.col("executed") > 0, on * F.col("ret_asset")).when(F.col("executed") < 0, 0.0).otherwise(neutral * F.col("ret_asset")))
    d = d.withColumns({"equity": compounded("ret_strategy", w), "equity_bench": compounded("ret", w), "equity_asset": compounded("ret_asset", w), "price_bench": F.coalesce(F.lead("__b").over(w), "__b"), "price_asset": F.coalesce(F.lead("__a").over(w), "__a")})
    return d.withColumn("dd", drawdown("equity", w)).drop("__a", "__b")


def web_modes(signal: DataFrame, by: tuple[str, ...] = (), neutral: float = 0.40) -> DataFrame:
    """``asset_backtest`` of each series ``by`` in three modes: at the close of the day, at the next close, at the next open."""
    out = None
    for mode, price, delay in (("close0", "close", 0), ("close1", "close", 1), ("open1", "open", 1)):
        t = asset_backtest(signal, price, delay, neutral, by=(U, *by)).withColumn("mode", F.lit(mode))
        out = t if out is None else out.unionByName(t)
    return out


def in_range(signal: DataFrame, start: Column | None = None, end: Column | None = None, by: tuple[str, ...] = (U,)) -> DataFrame:
    """Rows between two days, numbered anew, so that the first has nothing to execute."""
    kept = signal if start is None else signal.filter(F.col("d") >= start)
    kept = kept if end is None else kept.filter(F.col("d") <= end)
    return kept.withColumn("idx", (F.row_number().over(series(*by)) - 1).cast("int"))


def tomorrow_open(signal: DataFrame, start: Column | None = None, end: Column | None = None, neutral: float = 0.33, on: float = 1.0, delay: int = 1) -> tuple[DataFrame, DataFrame]:
    """A decision traded at the next open within a range of days, and the manifest: one row a universe."""
    tested = asset_backtest(in_range(signal, start, end), "open", max(1, delay), neutral, on)
    facts = tested.groupBy(U).agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    given = lambda day, found: F.coalesce(day, F.col(found)) if day is not None else F.col(found)
    return tested, facts.select(U, F.lit("T+1_open").alias("execution_basis"), F.lit("open").alias("price_mode"), F.lit(max(1, delay)).alias("delay_days"), given(start, "first_d").alias("start_d"), given(end, "last_d").alias("end_d"), F.lit("America/New_York").alias("tz"))


def with_runner_leverage(signal: DataFrame, dynamic: bool = False, leverage: float = 3.0, ramp: tuple[float, float] = (0.50, 1.20), bounds: tuple[float, float] = (1.0, 3.0), damp: float = 1.25) -> DataFrame:
    """``leverage`` of an on day from ``mm, bench10, ratio``: fixed or by a ramp of the ratio, less in a falling, highly correlated market."""
    bear = F.coalesce(F.col("mm") >= 0.90, F.lit(False)) & F.coalesce(F.col("bench10") <= 0, F.lit(True))
    if not dynamic:
        return signal.withColumn("leverage", F.when(bear, 1.0).otherwise(leverage))
    low, high = bounds
    part = F.coalesce(F.least(F.greatest((F.col("ratio") - ramp[0]) / (ramp[1] - ramp[0]), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    part = F.when(F.col("ratio").isNull(), 0.0).otherwise(part)
    full = low + (high - low) * part
    return signal.withColumn("leverage", F.when(bear, F.greatest(F.lit(low), F.least(full, F.lit(damp)))).otherwise(full))


def runner_backtest(signal: DataFrame, by: tuple[str, ...] = (U,)) -> DataFrame:
    """On: the day from its open, times ``leverage``; neutral: from the close before; off: cash.  The benchmark is close to close."""
    w = series(*by)
    daily = F.coalesce(simple_return("close", w), F.lit(0.0))
    d = signal.withColumns({"executed": executed("state", w), "ret": daily})
    day = F.coalesce(ratio("close", "open") - 1, F.col("ret"))
    d = d.withColumn("ret_strategy", F.when(F.col("executed") > 0, F.greatest(F.lit(-0.99), F.col("leverage") * day)).when(F.col("executed") < 0, 0.0).otherwise(F.col("ret")))
    d = d.withColumns({"equity": compounded("ret_strategy", w), "equity_bench": compounded("ret", w)})
    return d.withColumn("dd", drawdown("equity", w))


def timing_hits(tested: DataFrame, k: int = 5, by: tuple[str, ...] = (U,)) -> DataFrame:
    """How often entries into on and off were followed by a gain and a loss over up to ``k`` rows: one row a universe."""
    w = series(*by)
    ahead = F.coalesce(F.exp(F.sum(F.ln(1 + F.col("ret"))).over(w.rowsBetween(1, k))) - 1, F.lit(0.0))
    d = tested.withColumns({"__before": F.lag("state").over(w), "__ahead": ahead}).filter("__before is not null and state != __before and state != 0")
    one = lambda s, hit: F.avg(F.when(F.col("state") == s, F.when(hit, 1.0).otherwise(0.0)))
    return d.groupBy(*by).agg(
        F.coalesce(one(1, F.col("__ahead") > 0), F.lit(0.0)).alias("on_hits"), F.coalesce(one(-1, F.col("__ahead") < 0), F.lit(0.0)).alias("off_hits"),
        F.count(F.when(F.col("state") == 1, 1)).alias("n_on"), F.count(F.when(F.col("state") == -1, 1)).alias("n_off"),
    )


def captures(tested: DataFrame, by: tuple[str, ...] = (U,)) -> DataFrame:
    """Shares of executed states, and how often the row after an on, neutral or off row rose; the last row counts in the shares' base only."""
    w = series(*by)
    d = tested.withColumn("__next", F.lead("ret").over(w))
    here = lambda s: (F.signum("executed") == s) & F.lead("idx").over(w).isNotNull()
    d = d.withColumns({f"__{k}": here(s) for k, s in (("on", 1), ("off", -1), ("neutral", 0))})
    share = lambda k: (F.count(F.when(F.col(f"__{k}"), 1)) / F.count("*")).alias(f"share_{k}")
    rose = lambda k: F.coalesce(F.avg(F.when(F.col(f"__{k}"), (F.col("__next") > 0).cast("double"))), F.lit(0.0))
    return d.groupBy(*by).agg(share("on"), share("off"), share("neutral"), rose("on").alias("on_capture"), rose("neutral").alias("neutral_miss"), rose("off").alias("off_miss"))


def with_levered(tested: DataFrame, leverage: float = 3.0, by: tuple[str, ...] = (U,)) -> DataFrame:
    """With ``equity_levered``, what holding the levered asset all the time returned, 1 on the first row."""
    w = series(*by)
    held = compounded(levered_return("ret", leverage), w)
    return tested.withColumn("__e", held).withColumn("equity_levered", ratio("__e", F.first("__e").over(w))).drop("__e")
