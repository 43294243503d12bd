"""From a panel to one record a day: rolling correlations, coupling index, sub-indices.

The panel is turned to one wide row a day first (the only shuffle by day); returns are lags within the
universe, and the pairs of a day are made from its row, so no series is joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import CATEGORY, CLUSTER, SIGNALS, SYMBOLS, WINDOWS, pair_kind, pairs
from tidemark.functions.numeric import pair_weight
from tidemark.operators import eigen, moments
from tidemark.operators.align import U, pair_rows
from tidemark.operators.folds import with_ema
from tidemark.operators.rolling import log_return, rolling_correlation, series, simple_return


def name(symbol: str) -> str:
    return symbol.replace("-", "_")


def wide_aligned(panel: DataFrame, symbols: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """``universe, idx, d`` and ``c_*``, ``o_*`` of every symbol, for the days that all symbols have."""
    day = panel.groupBy(U, "d").pivot("symbol", list(symbols)).agg(F.first("close", ignorenulls=True).alias("c"), F.first("open", ignorenulls=True).alias("o"))
    closes = [F.col(f"`{s}_c`").alias(f"c_{name(s)}") for s in symbols]
    opens = [F.coalesce(F.col(f"`{s}_o`"), F.col(f"`{s}_c`")).alias(f"o_{name(s)}") for s in symbols]
    full = day.select(U, "d", *closes, *opens).dropna(subset=[f"c_{name(s)}" for s in symbols])
    return full.withColumn("idx", F.row_number().over(Window.partitionBy(U).orderBy("d")) - 1)


def with_returns(wide: DataFrame, symbols: tuple[str, ...] = SYMBOLS, kind: str = "log") -> DataFrame:
    """``wide`` with ``r_*``; NULL on the first day."""
    w = series(U)
    f = log_return if kind == "log" else simple_return
    return wide.withColumns({f"r_{name(s)}": f(f"c_{name(s)}", w) for s in symbols})


def pairs_of(wide: DataFrame, prefix: str, symbols: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """Pair rows ``s1, s2, kind, x, y`` of the columns ``prefix_*``."""
    return pair_rows(wide.select(U, "idx", "d", *(F.col(f"{prefix}_{name(s)}").alias(s) for s in symbols)), symbols)


def cell(a: str, b: str) -> str:
    """The column of the correlation of two symbols, in universe order."""
    return f"k_{name(a)}_{name(b)}"


def correlation_spec(windows: tuple[int, ...], symbols: tuple[str, ...] = SYMBOLS) -> dict[str, moments.Moment]:
    """The moments ``k_*`` of every pair of log returns; with several windows the name ends with the window."""
    named = lambda a, b, n: cell(a, b) if len(windows) == 1 else f"{cell(a, b)}__{n}"
    return {named(a, b, n): moments.Correlation(f"r_{name(a)}", f"r_{name(b)}", n) for a, b in pairs(symbols) for n in windows}


def with_correlations(wide: DataFrame, window: int = 30, symbols: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """``k_*`` of every pair from the log returns of full frames; NULL before."""
    return moments.with_moments(wide, correlation_spec((window,), symbols))


def _pair_rows(wide: DataFrame, symbols: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """A row a day and pair: ``s1, s2, kind`` and for each of ``columns`` the pair's value, whose name ends as given."""
    entries = []
    for a, b in pairs(symbols):
        kind = pair_kind(a, b)
        first, second = (b, a) if kind == "cross" and CLUSTER[a] == "safe" else (a, b)
        entries.append(F.struct(F.lit(first).alias("s1"), F.lit(second).alias("s2"), F.lit(kind).alias("kind"), *(F.col(cell(a, b) + end).alias(c) for c, end in columns.items())))
    return wide.select(U, "idx", "d", F.inline(F.array(*entries)))


def correlations_over(panel: DataFrame, windows: tuple[int, ...] = WINDOWS, symbols: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """``universe, s1, s2, kind, idx, d, window, corr``: the correlations of all ``windows`` from one pass over each universe."""
    wide = moments.with_moments(with_returns(wide_aligned(panel)), {k if len(windows) > 1 else f"{k}__{windows[0]}": m for k, m in correlation_spec(windows, symbols).items()})
    rows = _pair_rows(wide, symbols, {f"c{n}": f"__{n}" for n in windows})
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("window"), F.col(f"c{n}").alias("corr")) for n in windows)))
    return rows.select(U, "s1", "s2", "kind", "idx", "d", each).filter("corr is not null")


def correlations(panel: DataFrame, window: int = 30, symbols: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """``universe, s1, s2, kind, idx, d, corr`` of ``window`` log returns, for full frames.

    ``symbols`` picks the pairs; the calendar is always that of the whole universe.  The correlations are columns of
    the day's row and become pair rows last, so pairs are never shuffled.
    """
    wide = with_correlations(with_returns(wide_aligned(panel)), window, symbols)
    return _pair_rows(wide, symbols, {"corr": ""}).filter("corr is not null")


def pair_view(panel: DataFrame, window: int = 30, symbols: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """As ``correlations`` from simple returns, with both closes; NULL where a variance is 0.

    The first frame holds the missing first return, so it has one value less.
    """
    wide = with_returns(wide_aligned(panel), kind="simple")
    both = rolling_correlation(pairs_of(wide, "r", symbols), window, zero=None, least=2).filter(F.col("idx") >= window - 1)
    prices = pairs_of(wide, "c", symbols).select(U, "idx", "s1", "s2", F.col("x").alias("price_a"), F.col("y").alias("price_b"))
    return both.drop("x", "y").join(prices, [U, "idx", "s1", "s2"])


def _category(c: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORY.items() for x in kv)), F.col(c))


def daily(corr: DataFrame, symbols: tuple[str, ...] = SIGNALS) -> DataFrame:
    """One record a day: ``stability`` (weighted mean of absolute correlations), sub-indices, the pair IWM-BTC.

    Everything is one aggregation of the pair rows, with a map-side part.
    """
    rows = corr.filter(F.col("s1").isin(*symbols) & F.col("s2").isin(*symbols)).withColumns({"a": _category("s1"), "b": _category("s2")})
    weight, size = pair_weight("a", "b"), F.abs("corr")
    has = lambda x: (F.col("a") == x) | (F.col("b") == x)
    plain = F.col("a").isin("stock", "bond", "gold") & F.col("b").isin("stock", "bond", "gold")
    hedge = plain & has("stock") & (F.col("a") != F.col("b")) & (has("bond") | has("gold"))
    mean = lambda when, x: F.coalesce(F.avg(F.when(when, x)), F.lit(0.0))
    return rows.groupBy(U, "idx", "d").agg(
        (F.sum(weight * size) / F.sum(weight)).alias("stability"),
        mean(has("stock") & has("crypto"), size).alias("stock_crypto"), mean(plain, size).alias("traditional"),
        mean(hedge, F.greatest(F.lit(0.0), -F.col("corr"))).alias("safe_negative"),
        F.max(F.when((F.col("s1") == "IWM") & (F.col("s2") == "BTC-USD"), F.col("corr"))).alias("pair_corr"),
    )


def smoothed(records: DataFrame) -> DataFrame:
    """Records with ``smoothed`` (EMA 10) and ``delta`` (EMA 3 - EMA 10) of the stability."""
    e = with_ema(records, {"__e3": ("stability", 3), "smoothed": ("stability", 10)})
    return e.withColumn("delta", F.col("__e3") - F.col("smoothed")).drop("__e3")


def absorption(corr: DataFrame, symbols: tuple[str, ...] = SIGNALS) -> DataFrame:
    """``universe, idx, d, mm, upper``: the share of the first component of each day's matrix."""
    upper = eigen.upper_triangles(corr, symbols)
    return upper.withColumn("mm", eigen.absorption("upper"))


def stability_by_cluster(corr: DataFrame) -> DataFrame:
    """``universe, idx, stability``: the mean of absolute correlations in which pairs across clusters weigh double."""
    w = F.when(F.col("kind") == "cross", 2.0).otherwise(1.0)
    return corr.groupBy(U, "idx").agg((F.sum(w * F.abs("corr")) / F.sum(w)).alias("stability"))


def summary(records: DataFrame) -> DataFrame:
    """One row a universe: mean of the last 180 records, mean of the last 10 steps, quantiles of the stability."""
    w = series(U)
    d = records.withColumns({"__step": F.col("stability") - F.lag("stability").over(w), "__n": F.row_number().over(w.orderBy(F.desc("idx")))})
    last = lambda c, k: F.avg(F.when(F.col("__n") <= k, F.col(c)))
    return d.groupBy(U).agg(last("stability", 180).alias("average180"), last("__step", 10).alias("slope10"), F.percentile("stability", 0.3).alias("q30"), F.percentile("stability", 0.7).alias("q70"))


def full_records(panel: DataFrame, window: int = 30) -> DataFrame:
    """The daily frame: records with smoothing, absorption and all closes and opens of the day."""
    from tidemark.plans import frame

    return frame.daily(panel, window)
