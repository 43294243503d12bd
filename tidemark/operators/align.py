"""Joins that put series on one calendar.

A panel has one row per ``universe, symbol, d``.  Alignment keeps the days on which every symbol has a
price and numbers them from 0 (``idx``); every later offset is a ``lag`` or ``lead`` over ``idx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SYMBOLS, pair_kind, pairs

U = "universe"


def last_wins(rows: DataFrame, keys: list[str], order: str | Column, *ties: str) -> DataFrame:
    """One row per key: the last by ``order``, of equal ones the first by ``ties``."""
    w = Window.partitionBy(*keys).orderBy((F.col(order) if isinstance(order, str) else order).desc(), *ties)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def calendar(panel: DataFrame, n_symbols: int = len(SYMBOLS)) -> DataFrame:
    """``universe, d, idx`` of the days that all symbols share.

    Days are aggregated before they are numbered, so the one ordered pass sees a row a day.
    """
    days = panel.filter(F.col("close").isNotNull()).groupBy(U, "d").agg(F.count_distinct("symbol").alias("n")).filter(F.col("n") == n_symbols)
    return days.select(U, "d", (F.row_number().over(Window.partitionBy(U).orderBy("d")) - 1).alias("idx"))


def align(panel: DataFrame, symbols: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """The panel on the shared calendar, with ``idx``; ``open`` falls back to ``close``.

    One aggregation turns the symbols of a day to a row, days are numbered, and the row is opened again: the
    panel is read once and nothing is joined.
    """
    bar = lambda s: F.first(F.when(F.col("symbol") == s, F.struct(F.coalesce("open", "close").alias("open"), "close")), ignorenulls=True)
    days = panel.filter(F.col("symbol").isin(*symbols) & F.col("close").isNotNull()).groupBy(U, "d").agg(F.array(*(F.struct(F.lit(s).alias("symbol"), bar(s).alias("bar")) for s in symbols)).alias("bars"))
    full = days.filter(F.forall("bars", lambda b: b["bar"].isNotNull())).withColumn("idx", F.row_number().over(Window.partitionBy(U).orderBy("d")) - 1)
    return full.select(U, "d", "idx", F.explode("bars").alias("b")).select(U, "d", "b.symbol", "b.bar.open", "b.bar.close", "idx")


def opens_on(closes: DataFrame, opens: DataFrame) -> DataFrame:
    """Left join of ``opens(universe, symbol, d, open)``; a missing open is the close."""
    return closes.drop("open").join(opens.select(U, "symbol", "d", "open"), [U, "symbol", "d"], "left").withColumn("open", F.coalesce("open", "close"))


def opens_filled(closes: DataFrame, opens: DataFrame) -> DataFrame:
    """As ``opens_on``, but a missing open is the last known one before it is the close."""
    met = closes.drop("open").join(opens.select(U, "symbol", "d", "open"), [U, "symbol", "d"], "left")
    w = Window.partitionBy(U, "symbol").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("open", F.coalesce(F.last("open", ignorenulls=True).over(w), "close"))


def with_history(history: DataFrame, live: DataFrame) -> DataFrame:
    """Live rows, behind the history before a symbol's first live day; symbols without live rows keep all."""
    first = live.groupBy(U, "symbol").agg(F.min("d").alias("__first"))
    old = history.join(first, [U, "symbol"], "left").filter(F.col("__first").isNull() | (F.col("d") < F.col("__first"))).drop("__first")
    return old.unionByName(live.select(*old.columns))


def right_wins(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join; a value of ``right`` beats one of ``left``."""
    values = [c for c in left.columns if c not in on]
    r = right.select(*on, *(F.col(c).alias(f"__{c}") for c in values))
    return left.join(r, on, "full_outer").select(*on, *(F.coalesce(f"__{c}", c).alias(c) for c in values))


def levered_prices(made: DataFrame, real: DataFrame, on: tuple[str, ...] = (U, "d")) -> DataFrame:
    """``made(levered)`` with the real levered asset's ``close`` where it has one that day."""
    known = real.select(*on, F.col("close").alias("__real")).filter("__real is not null")
    return made.join(known, list(on), "left").withColumn("levered", F.coalesce("__real", "levered")).drop("__real")


def upsert(panel: DataFrame, quotes: DataFrame) -> DataFrame:
    """The panel with the close of each quote's day replaced or added."""
    new = quotes.select(U, "symbol", "d", F.lit(None).cast("double").alias("open"), F.col("price").alias("close"), F.lit(1).alias("__p"))
    both = panel.select(U, "symbol", "d", "open", "close", F.lit(0).alias("__p")).unionByName(new)
    return both.groupBy(U, "symbol", "d").agg(F.max_by("open", F.when(F.col("open").isNotNull(), F.col("__p"))).alias("open"), F.max_by("close", "__p").alias("close"))


def day_stub(panel: DataFrame, day: Column) -> DataFrame:
    """If any symbol has ``day``, symbols without it get their last close there."""
    before = panel.filter(F.col("d") <= day).groupBy(U, "symbol").agg(F.max_by("close", "d").alias("close"), F.max("d").alias("last"))
    there = panel.filter(F.col("d") == day).select(U).distinct()
    stubs = before.join(there, U).filter(F.col("last") < day).select(U, "symbol", day.alias("d"), F.col("close").alias("open"), "close")
    return panel.select(U, "symbol", "d", "open", "close").unionByName(stubs)


def as_of(targets: DataFrame, values: DataFrame, keys: list[str], value: str, on: str = "d") -> DataFrame:
    """``targets`` with the last ``value`` at or before ``on``: one union and one ordered pass, no range join."""
    t = targets.withColumn("__side", F.lit(1)).withColumn(value, F.lit(None).cast(values.schema[value].dataType))
    v = values.select(*keys, on, value).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = t.unionByName(v, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__side = 1").drop("__side")


def pair_rows(wide: DataFrame, symbols: tuple[str, ...] = SYMBOLS, keep: tuple[str, ...] = (U, "idx", "d")) -> DataFrame:
    """``s1, s2, kind, x, y`` of every unordered pair and day, from one row per day: no self join.

    In ``cross`` pairs ``s1`` is the risk symbol.
    """
    from tidemark.config import CLUSTER

    entries = []
    for a, b in pairs(symbols):
        kind = pair_kind(a, b)
        a, b = (b, a) if kind == "cross" and CLUSTER[a] == "safe" else (a, b)
        entries.append(F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"), F.lit(kind).alias("kind"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")))
    return wide.select(*keep, F.inline(F.array(*entries)))


def missing_symbols(panel: DataFrame, required: DataFrame) -> DataFrame:
    """``required(symbol)`` without a row in the panel."""
    return required.join(panel.select("symbol").distinct(), "symbol", "left_anti")
