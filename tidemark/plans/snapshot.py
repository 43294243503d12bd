"""What a day shows: which row counts, last values with their fallbacks, the engines' values side by side.

A snapshot is one row a universe (``max_by`` over its days); nothing walks through a payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import SYMBOLS
from tidemark.operators.islands import executed
from tidemark.operators.rolling import series

U = "universe"


def effective_row(days: DataFrame, facts: DataFrame, fallback: bool = False, base: str = "QQQ") -> DataFrame:
    """``universe, idx_last, idx, used_fallback, reason``: the last row, or with ``fallback`` the one before it.

    ``facts`` has a row a universe: ``fusion_last, today, stubbed array<string>, intraday, quotes``.  The last row is passed over
    if it is today's and the base is a stub, was not patched intraday, or no quotes came.
    """
    last = days.groupBy(U).agg(F.max("idx").alias("idx_last")).join(facts, U, "left")
    stubbed = F.coalesce(F.array_contains(F.transform("stubbed", F.upper), base.upper()), F.lit(False))
    patched, quoted = F.coalesce("intraday", F.lit(False)), F.coalesce("quotes", F.lit(False))
    back = F.lit(fallback) & (F.col("idx_last") > 0) & F.col("fusion_last").eqNullSafe(F.col("today")) & (stubbed | ~patched | ~quoted)
    why = F.concat_ws(", ", F.when(stubbed, f"{base} stubbed"), F.when(~patched, "intraday base not patched"), F.when(~quoted, "quotes missing"))
    return last.select(U, "idx_last", (F.col("idx_last") - back.cast("int")).alias("idx"), back.alias("used_fallback"), F.when(back, why).otherwise("").alias("reason"))


def normalized(states: DataFrame, prices: DataFrame, candidates: tuple[str, ...], today: Column, bench: tuple[str, ...] = ("QQQ", "SPY")) -> DataFrame:
    """The last row of each universe: state, executed state, score, weights, the first known symbol's price and the benchmark's.

    ``states`` has ``idx, d, state, score, w_trend, w_flow``; ``prices`` has ``symbol, d, open, close``.
    """
    d = states.withColumn("executed", executed("state", series(U)))
    last = d.groupBy(U).agg(F.max_by(F.struct("d", "state", "executed", "score", "w_trend", "w_flow"), "idx").alias("x")).select(U, "x.*")
    wanted = [*candidates, *bench]
    at = prices.filter(F.col("symbol").isin(*wanted)).groupBy(U).agg(
        *(F.max_by("close", F.when(F.col("symbol") == s, F.col("d"))).alias(f"c{i}") for i, s in enumerate(wanted)), *(F.max_by("open", F.when(F.col("symbol") == s, F.col("d"))).alias(f"o{i}") for i, s in enumerate(wanted)),
    )
    n = len(candidates)
    known = F.coalesce(*(F.col(f"c{i}") for i in range(len(wanted))))
    both = last.join(at, U, "left")
    return both.select(*last.columns, known.alias("price"), F.coalesce(*(F.col(f"c{i}") for i in range(n, len(wanted)))).alias("price_bench"), F.coalesce(*(F.col(f"o{i}") for i in range(n, len(wanted)))).alias("open_bench"), (F.col("d") == today).alias("last_is_today"))


def basis(snapshot: DataFrame) -> DataFrame:
    """With ``basis_d``, the first known of ``fusion_last, inter_last, today, d``, and the last weights that are known."""
    return snapshot.withColumns({"basis_d": F.coalesce("fusion_last", "inter_last", "today", "d")})


def last_weights(states: DataFrame) -> DataFrame:
    """``universe, w_trend, w_flow``: each the last known one."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(c)
    return states.groupBy(U).agg(known("w_trend"), known("w_flow"))


def previous_row(days: DataFrame, before: DataFrame) -> DataFrame:
    """``universe, idx``: the row of ``before(universe, prev_close)``; where that is unknown or no row, the last but one, or the only one."""
    d = days.join(before, U, "left").withColumn("__day", F.col("d") == F.col("prev_close"))
    found = d.groupBy(U).agg(F.max(F.when(F.col("__day"), F.col("idx"))).alias("at"), F.max("idx").alias("last"))
    return found.select(U, F.coalesce("at", F.greatest(F.col("last") - 1, F.lit(0))).cast("int").alias("idx"))


def first_finite(engines: dict[str, DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """``idx`` and each column from the first engine that has a value for it, in the order given; the days are the first engine's."""
    frames = list(engines.values())
    out = frames[0].select(U, "idx", *(F.col(c).alias(f"{c}__0") if c in frames[0].columns else F.lit(None).cast("double").alias(f"{c}__0") for c in columns))
    for i, f in enumerate(frames[1:], 1):
        have = [c for c in columns if c in f.columns]
        out = out.join(f.select(U, "idx", *(F.col(c).alias(f"{c}__{i}") for c in have)), [U, "idx"], "left")
    return out.select(U, "idx", *(F.coalesce(*(x for x in out.columns if x.rsplit("__", 1)[0] == c and x != c)).alias(c) for c in columns))


def matrix_for(records: DataFrame, n_symbols: int) -> DataFrame:
    """``records(full, matrix)`` with ``chosen``: the first of the two arrays whose length is ``n_symbols``."""
    of = lambda c: F.when(F.size(c) == n_symbols, F.col(c))
    return records.withColumn("chosen", F.coalesce(of("full"), of("matrix")))


def matrix_value(corr: DataFrame, a: str, b: str) -> DataFrame:
    """``universe, idx, value``: the correlation of two symbols in either order; 1 for one symbol with itself."""
    if a == b:
        return corr.select(U, "idx").distinct().withColumn("value", F.lit(1.0))
    return corr.filter(F.col("s1").isin(a, b) & F.col("s2").isin(a, b)).select(U, "idx", F.col("corr").alias("value"))


def complete_universes(panel: DataFrame, symbols: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """The panel of those universes that have every symbol; the others go whole."""
    full = panel.filter(F.col("symbol").isin(*symbols)).groupBy(U).agg((F.count_distinct("symbol") == len(symbols)).alias("__full")).filter("__full").select(U)
    return panel.join(full, U, "left_semi")


def allocation(weights: DataFrame, least: float = 0.001, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``symbol, weight, rank`` of what is invested (cash aside) above ``least``, the heaviest first; ties by symbol."""
    from pyspark.sql import Window

    kept = weights.filter((F.col("symbol") != "CASH") & (F.col("weight") > least))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "symbol")))


def bench_snapshot(days: DataFrame, prices: DataFrame, base: str = "QQQ") -> DataFrame:
    """``universe, d, price``: the last day and the base's last known price."""
    last = days.groupBy(U).agg(F.max("d").alias("d"))
    price = prices.filter(F.col("symbol") == base).groupBy(U).agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("d"))).alias("price"))
    return last.join(price, U, "left")


def report_view(report: DataFrame, records: DataFrame, top: DataFrame) -> DataFrame:
    """One row a universe: the probability with its bounds, the last day, the mean of its last ten deltas, the strongest driver.

    ``report`` has ``p_up, p_raw, low, high``, ``records`` has ``d, delta``, ``top`` comes from ``report.top_drivers``.
    """
    w = series(U, order="d").orderBy(F.desc("d"))
    recent = records.withColumn("__n", F.row_number().over(w)).groupBy(U).agg(F.max("d").alias("d"), F.avg(F.when(F.col("__n") <= 10, F.col("delta"))).alias("slope"), F.count("*").alias("n_records"))
    lead = top.filter("rank = 1").select(U, F.col("feature").alias("strongest"), F.col("llr").alias("strongest_llr"))
    return report.join(recent, U).join(lead, U, "left")
