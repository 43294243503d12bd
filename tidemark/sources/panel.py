"""Price panels: rows ``universe, symbol, d, open, close``, one per symbol and day.

``from_trades`` builds bars from any trade table by volume-weighted prices; ``from_line_items`` applies
it to ``lineitem`` and ``part``, whose six part types stand for the six symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SYMBOLS

# Which part type stands for which symbol.
PART_TYPES = {"STANDARD": "QQQ", "LARGE": "IWM", "MEDIUM": "SPY", "SMALL": "TLT", "ECONOMY": "GLD", "PROMO": "BTC-USD"}


def from_trades(trades: DataFrame, symbol: Column, day: Column, traded: Column, listed: Column, quantity: Column, universe: Column | None = None) -> DataFrame:
    """Bars with ``close = sum(traded) / sum(quantity)`` and ``open = sum(listed) / sum(quantity)``.

    Partial sums are made where the trades are read; a bar shuffles one row per task.
    """
    keyed = trades.select((universe if universe is not None else F.lit("core")).alias("universe"), symbol.alias("symbol"), day.alias("d"), traded.alias("t"), listed.alias("o"), quantity.alias("q"))
    bars = keyed.filter(F.col("symbol").isNotNull() & F.col("d").isNotNull()).groupBy("universe", "symbol", "d").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.sum("q").alias("q"))
    return bars.select("universe", "symbol", "d", F.try_divide("o", "q").alias("open"), F.try_divide("t", "q").alias("close"))


def from_line_items(spark: SparkSession, sf_dir: str, bucket: str = "day", universe: str | None = None) -> DataFrame:
    """The six-symbol panel of ``lineitem``; ``universe`` names a column that splits it into several."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    kinds = F.create_map(*(F.lit(x) for kv in PART_TYPES.items() for x in kv))
    joined = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    day = F.to_date("l_shipdate") if bucket == "day" else F.to_date(F.date_trunc(bucket, "l_shipdate"))
    price = F.col("l_extendedprice")
    return from_trades(joined, F.element_at(kinds, F.col("p_type")), day, price * (1 - F.col("l_discount")), price, F.col("l_quantity"), F.col(universe) if universe else None)


def wide(panel: DataFrame, value: str = "close", symbols: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """One row per day with a column per symbol; the symbol list is fixed, so no extra pass finds it."""
    kept = [c for c in ("universe", "idx", "d") if c in panel.columns]
    return panel.groupBy(*kept).pivot("symbol", list(symbols)).agg(F.first(value))
