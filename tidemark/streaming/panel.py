"""A panel that grows by micro-batches: a batch rewrites only the months it touches, and only days it can change are made again.

``parts/batch=n/universe=.../month=...`` holds the months that batch n changed, whole; ``log/batch=n`` names them with their
counts of complete days, and the mark ``marks/n`` makes the batch count.  The panel is the newest part of every universe
and month, so a reader sees whole batches only, a batch that died changes nothing, and one that is read twice is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import SYMBOLS
from tidemark.operators.align import upsert
from tidemark.plans import flow, frame
from tidemark.sources.versions import Files

U = "universe"
PANEL = f"{U} string, symbol string, d date, open double, close double"
LOG = f"{U} string, month string, n_days long, first_d date"


def month(day: str = "d"):
    return F.date_format(day, "yyyy-MM")


class PanelStore:
    def __init__(self, spark: SparkSession, path: str, symbols: tuple[str, ...] = SYMBOLS):
        self.spark, self.path, self.symbols = spark, path.rstrip("/"), symbols
        self.files = Files(spark, path)

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("marks") if n.isdigit())

    def log(self, upto: int | None = None) -> DataFrame:
        """``universe, month, n_days, first_d, batch`` of every part that counts, as of batch ``upto``."""
        known = [b for b in self.batches() if upto is None or b <= upto]
        if not known:
            return self.spark.createDataFrame([], f"{LOG}, batch long")
        rows = self.spark.read.schema(f"{LOG}, batch long").option("basePath", f"{self.path}/log").parquet(*(f"{self.path}/log/batch={b}" for b in known))
        newest = Window.partitionBy(U, "month").orderBy(F.desc("batch"))
        return rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")

    def read(self, upto: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """The panel, as of batch ``upto`` if named; of ``wanted(universe, month)`` only, whose folders alone are read."""
        known = self.log(upto)
        known = known if wanted is None else known.join(wanted.select(U, "month"), [U, "month"], "left_semi")
        if not self.batches():
            return self.spark.createDataFrame([], PANEL)
        parts = self.spark.read.schema(f"symbol string, d date, open double, close double, batch long, {U} string, month string").parquet(f"{self.path}/parts")
        return parts.join(known.select(U, "month", "batch"), [U, "month", "batch"], "left_semi").select(U, "symbol", "d", "open", "close")

    def merge(self, quotes: DataFrame, number: int) -> bool:
        """Put ``quotes(universe, symbol, d, price)`` into their months as batch ``number``; False if it was done before."""
        if number in self.batches():
            return False
        quotes = quotes.select(U, "symbol", "d", "price").withColumn("month", month()).persist()
        try:
            touched = quotes.select(U, "month").distinct()
            new = upsert(self.read(wanted=touched), quotes).withColumn("month", month())
            new.repartition(U, "month").write.mode("overwrite").partitionBy(U, "month").parquet(f"{self.path}/parts/batch={number}")
            written = self.spark.read.schema(f"symbol string, d date, open double, close double, {U} string, month string").parquet(f"{self.path}/parts/batch={number}")
            held = written.filter(F.col("symbol").isin(*self.symbols) & F.col("close").isNotNull()).groupBy(U, "month", "d").agg(F.count_distinct("symbol").alias("n"))
            full = held.groupBy(U, "month").agg(F.count(F.when(F.col("n") == len(self.symbols), 1)).alias("n_days"))
            first = quotes.groupBy(U, "month").agg(F.min("d").alias("first_d"))
            rows = first.join(full, [U, "month"], "left").select(U, "month", F.coalesce("n_days", F.lit(0)).alias("n_days"), "first_d")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")
        finally:
            quotes.unpersist()
        self.files.mark(f"marks/{number}")
        return True

    def changed(self, number: int) -> DataFrame:
        """``universe, first_d``: the first day that batch ``number`` changed."""
        rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log/batch={number}")
        return rows.groupBy(U).agg(F.min("first_d").alias("first_d"))

    def days_again(self, number: int, window: int = 30) -> DataFrame:
        """``frame.inputs`` with ``flow.day_columns`` of every day that batch ``number`` can have changed: those from its first day on.

        Whole months are read, as many before that day as the windows reach back; ``idx`` counts from the history's first day.
        """
        reach = max(window, 20) + 2
        order = Window.partitionBy(U).orderBy("month")
        months = self.log(number).select(U, "month", "n_days").withColumn("before", F.sum("n_days").over(order) - F.col("n_days"))
        asked = self.changed(number).withColumn("asked", month("first_d"))
        met = months.join(asked, U)
        at = met.filter("month = asked").select(U, F.col("before").alias("held"))
        start = met.join(at, U).filter((F.col("month") <= F.col("asked")) & ((F.col("held") - F.col("before") >= reach) | (F.col("before") == 0)))
        start = start.groupBy(U).agg(F.max_by("before", "month").alias("skipped"), F.max("month").alias("from"), F.first("first_d").alias("first_d"))
        wanted = months.join(start, U).filter(F.col("month") >= F.col("from")).select(U, "month")
        made = flow.day_columns(frame.inputs(self.read(number, wanted), window)).join(start.select(U, "skipped", "first_d"), U)
        return made.filter(F.col("d") >= F.col("first_d")).withColumn("idx", (F.col("idx") + F.col("skipped")).cast("int")).drop("skipped", "first_d")

    def clear(self, keep: int = 2) -> int:
        """Remove parts that no batch of the last ``keep`` reads; how many went."""
        done = self.batches()
        if len(done) <= keep:
            return 0
        needed = None
        for upto in done[-keep:]:
            one = self.log(upto).select(U, "month", "batch")
            needed = one if needed is None else needed.unionByName(one)
        old = self.spark.read.schema(LOG + ", batch long").option("basePath", f"{self.path}/log").parquet(*(f"{self.path}/log/batch={b}" for b in done)).select(U, "month", "batch")
        gone = old.join(needed.distinct(), [U, "month", "batch"], "left_anti").collect()  # names of folders, not rows of the panel
        for r in gone:
            self.files.remove(f"parts/batch={r['batch']}/{U}={r[U]}/month={r['month']}")
        return len(gone)


def merge_into(bars: DataFrame, store: PanelStore, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch of a stream of quotes into the store."""
    return bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: store.merge(batch, number) and None).start()


def last_wins(quotes: DataFrame, late: str = "2 days", keys: tuple[str, ...] = (U, "symbol", "d")) -> DataFrame:
    """A stream of ``quotes(..., ts, price)`` without repeats: a bar that came again with the same time and price passes once within ``late``.

    Corrections differ in time or price, pass, and replace what the store holds; the watermark bounds what is remembered.
    """
    return quotes.withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "ts", "price"])
