"""Readers and their transforms: price history, vendor bars, quotes, text tables, models, symbol lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.numeric import finite, number
from tidemark.operators.align import last_wins

HISTORY = "generatedAt string, startDate string, endDate string, source string, assets array<struct<symbol:string,label:string,category:string,dates:array<string>,prices:array<double>,opens:array<double>>>"
MODEL = "mu_up array<double>, var_up array<double>, mu_dn array<double>, var_dn array<double>, prior_up double, calib array<double>, ts string"
TICKER = r"^[A-Z0-9.\-]{1,10}$"


def history(spark: SparkSession, path: str, symbols: tuple[str, ...] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Panel rows of a history file; an asset whose dates and prices differ in length is dropped.

    Raises where a required symbol has no rows.
    """
    rows = history_rows(spark.read.schema(HISTORY).json(path, multiLine=True), symbols)
    missing = [s for s in required if s not in {r["symbol"] for r in rows.select("symbol").filter(F.col("symbol").isin(*required)).distinct().collect()}]
    if missing:
        raise ValueError(f"{path}: no rows of {', '.join(missing)}")
    return rows


def history_rows(raw: DataFrame, symbols: tuple[str, ...] | None = None) -> DataFrame:
    a = raw.select(F.explode("assets").alias("a")).select("a.*").filter(F.size("dates") == F.size("prices"))
    a = a.filter(F.col("symbol").isin(*symbols)) if symbols else a
    rows = a.select("symbol", F.inline(F.arrays_zip(F.col("dates"), F.col("prices"), F.coalesce("opens", F.array().cast("array<double>")).alias("opens"))))
    return trimmed(rows.select(F.lit("core").alias("universe"), "symbol", F.to_date("dates").alias("d"), F.coalesce(finite("opens"), finite("prices")).alias("open"), finite("prices").alias("close")))


def trimmed(rows: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows with a day and a finite close, within the bounds; a missing open is the close."""
    kept = rows.withColumns({"close": finite("close"), "open": finite("open")}).filter("d is not null and close is not null")
    kept = kept if start is None else kept.filter(F.col("d") >= start)
    kept = kept if end is None else kept.filter(F.col("d") <= end)
    return kept.withColumn("open", F.coalesce("open", "close"))


def vendor_bars(rows: DataFrame, *ties: str) -> DataFrame:
    """Panel rows from ``symbol, date, open, close, adjClose, price`` and a running ``seq``: the last row of a day wins.

    Where ``seq`` repeats within a day, the first row by the columns ``ties`` wins.

    Close is the adjusted close, else close, else price; the open is adjusted by the same factor.
    """
    close = F.coalesce(finite("adjClose"), finite("close"), finite("price"))
    factor = F.coalesce(F.try_divide(finite("adjClose"), finite("close")), F.lit(1.0))
    d = rows.select(F.lit("core").alias("universe"), "symbol", F.to_date("date").alias("d"), (finite("open") * factor).alias("open"), close.alias("close"), "seq", *ties)
    return last_wins(d.filter("d is not null and close is not null"), ["universe", "symbol", "d"], "seq", *ties).drop("seq", *ties)


def chart_rows(raw: DataFrame) -> DataFrame:
    """Panel rows of ``symbol, timestamp array<long>, close array<double>, adjclose array<double>`` (epoch seconds)."""
    rows = raw.select("symbol", F.inline(F.arrays_zip("timestamp", "close", "adjclose")))
    c = F.coalesce(finite("adjclose"), finite("close"))
    return rows.select(F.lit("core").alias("universe"), "symbol", F.to_date(F.timestamp_seconds("timestamp")).alias("d"), finite("close").alias("open"), c.alias("close")).filter("close is not null")


def quotes(rows: DataFrame) -> DataFrame:
    """``symbol, ts, price`` of quotes: a positive price, else a positive previous close, else nothing."""
    price = F.when(F.col("price") > 0, F.col("price")).when(F.col("prev_close") > 0, F.col("prev_close"))
    return rows.select("symbol", "ts", price.alias("price")).filter("price is not null")


def text_table(lines: DataFrame) -> DataFrame:
    """``d, stability, smoothed, delta`` from tab-separated text; other lines go, ``smoothed`` falls back to ``stability``."""
    part = F.split("value", "\t")
    scrub = lambda i: F.regexp_replace(F.get(part, F.lit(i)), r"[^0-9.+\-]", "").try_cast("double")
    d = lines.filter(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}\t")).select(F.get(part, F.lit(0)).try_cast("date").alias("d"), scrub(1).alias("stability"), scrub(2).alias("smoothed"), scrub(3).alias("delta"))
    return d.filter("d is not null and stability is not null").withColumn("smoothed", F.coalesce("smoothed", "stability"))


def overrides(rows: DataFrame, column: str = "value") -> DataFrame:
    """``symbol, price`` of JSON objects; entries that are no numbers are passed over."""
    m = F.from_json(column, T.MapType(T.StringType(), T.StringType()))
    d = rows.select(F.explode(m).alias("symbol", "raw")).select(F.upper(F.trim("symbol")).alias("symbol"), number("raw").alias("price"))
    return d.filter("price is not null")


def tickers(rows: DataFrame, column: str = "value", most: int = 15) -> DataFrame:
    """``tickers``: the first distinct symbols of a comma- or space-separated text, in capitals."""
    found = F.array_distinct(F.filter(F.split(F.upper(F.col(column)), r"[,\s]+"), lambda x: x.rlike(TICKER)))
    return rows.select("*", F.slice(found, 1, most).alias("tickers"))


def holdings(*baskets: DataFrame) -> DataFrame:
    """``symbol, basket, position`` where a symbol is first seen over all baskets; ill-formed symbols go."""
    union = None
    for i, b in enumerate(baskets):
        b = b.select(F.upper(F.trim("symbol")).alias("symbol"), F.lit(i).alias("basket"), "position")
        union = b if union is None else union.unionByName(b)
    kept = union.filter(F.col("symbol").rlike(TICKER))
    return kept.groupBy("symbol").agg(F.min(F.struct("basket", "position")).alias("f")).select("symbol", "f.basket", "f.position")


def model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).json(path, multiLine=True)


def cached(spark: SparkSession, path: str, now: Column, most_age: str = "10 minutes") -> DataFrame:
    """A Parquet snapshot with ``stale``: whether its ``as_of`` is older than ``most_age`` at ``now``."""
    return spark.read.parquet(path).withColumn("stale", F.col("as_of").isNull() | (F.col("as_of") < now - F.expr(f"interval {most_age}")))


class _Page(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class BarSource(DataSource):
    """``spark.read.format("daily_bars")``: one partition a symbol, so vendors are asked in parallel.

    ``fetch`` is an importable function ``package.module:name`` of ``(symbol, start, end)`` that yields
    ``(symbol, date, open, close, adjClose, price, seq)``; the library itself opens no network.
    """

    @classmethod
    def name(cls) -> str:
        return "daily_bars"

    def schema(self) -> str:
        return "symbol string, date string, open double, close double, adjClose double, price double, seq long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BarReader(self.options)


class _BarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Page]:
        return [_Page(s) for s in self.options["symbols"].split(",")]

    def read(self, partition: _Page) -> Iterator[tuple]:
        from importlib import import_module

        module, _, attribute = self.options["fetch"].partition(":")
        fetch: Callable = getattr(import_module(module), attribute)
        yield from fetch(partition.symbol, self.options.get("start"), self.options.get("end"))


def fetch_window(panel: DataFrame, cutoff: Column, today: Column) -> DataFrame:
    """``symbol, start`` of what is still to be fetched: the day after the last one, not before ``cutoff``."""
    last = panel.groupBy("universe", "symbol").agg(F.max("d").alias("last"))
    return last.select("universe", "symbol", F.greatest(F.date_add("last", 1), cutoff).alias("start")).filter(F.col("start") <= today)


def filtered(rows: DataFrame, last: int | None = None, start: Column | None = None, end: Column | None = None, by: tuple[str, ...] = ("universe",)) -> DataFrame:
    """Days between two bounds, or the last ``last`` rows of each series."""
    if start is not None or end is not None:
        rows = rows if start is None else rows.filter(F.col("d") >= start)
        return rows if end is None else rows.filter(F.col("d") <= end)
    w = Window.partitionBy(*by).orderBy(F.desc("d"))
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= last).drop("__n")


def with_row_before(rows: DataFrame, last: int | None = None, start: Column | None = None, end: Column | None = None, by: tuple[str, ...] = ("universe",)) -> DataFrame:
    """As ``filtered``, and the row before the first one kept, so that its return is known."""
    kept = filtered(rows, last, start, end, by)
    first = kept.groupBy(*by).agg(F.min("d").alias("__first"))
    before = rows.join(first, list(by)).filter(F.col("d") < F.col("__first")).groupBy(*by).agg(F.max("d").alias("d"))
    return rows.join(before, [*by, "d"], "left_semi").unionByName(kept)


def session_overrides(first: DataFrame, second: DataFrame, session: Column) -> DataFrame:
    """``symbol, price, source`` outside trading hours, from ``symbol, pre, post`` of two sources.

    The price of the session if it is above 0; the second source counts only if the first has none at all.
    """
    price = F.when(session == "pre", F.col("pre")).when(session == "post", F.col("post"))
    side = lambda rows, n: rows.select(F.upper("symbol").alias("symbol"), price.alias("price"), F.lit(n).alias("source")).filter("price > 0")
    one = side(first, 1)
    none = one.agg((F.count("*") == 0).alias("__none"))
    two = side(second, 2).join(F.broadcast(none), F.col("__none")).drop("__none")
    return one.unionByName(two)


def sector_rows(raw: DataFrame) -> DataFrame:
    """``sector, change`` from JSON objects whose fields go by any of their known names."""
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    pick = lambda *names: F.coalesce(*(F.element_at("m", n) for n in names))
    rest = [c for c in raw.columns if c != "value"]
    return raw.select(*rest, m.alias("m")).select(*rest, pick("sector", "name").alias("sector"), pick("changesPercentage", "changePercentage", "change").alias("change")).filter("sector is not null")


def holder_rows(raw: DataFrame) -> DataFrame:
    """``symbol, position`` of holders as JSON objects, under any of the known names; ``position`` is the row's place ``n``."""
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return raw.select(m.alias("m"), F.col("n").alias("position")).select(F.coalesce(*(F.element_at("m", n) for n in ("assetSymbol", "symbol", "asset", "ticker"))).alias("symbol"), "position").filter("symbol is not null")


def report(spark: SparkSession, path: str) -> DataFrame:
    """A stored report: ``p_up, p_raw, drivers, features``; drivers are arrays of a name and a number, read as text."""
    return spark.read.schema("prob struct<p_up:double,p_up_raw:double>, drivers array<array<string>>, features map<string,double>, markdown string").json(path, multiLine=True).select(
        F.col("prob.p_up").alias("p_up"), F.col("prob.p_up_raw").alias("p_raw"), F.transform("drivers", lambda x: F.struct(F.get(x, F.lit(0)).alias("feature"), F.get(x, F.lit(1)).try_cast("double").alias("llr"))).alias("drivers"), "features", "markdown",
    )
