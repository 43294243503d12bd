"""Structured Streaming: quote upserts, windowed event counts, a stateful regime latch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.align import upsert


def latest_bars(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Last price of each ``symbol`` and day of ``stream(symbol, ts, price)``; later rows beat earlier ones."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "symbol")
    return w.agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("ts")).select(F.lit("core").alias("universe"), "symbol", F.to_date("window.start").alias("d"), "price", "ts")


def upsert_into(bars: DataFrame, panel: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch of ``bars`` into the panel.

    ``save(rows, batch)`` must write by batch number, so a repeated batch replaces itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        save(upsert(panel(), batch), number)

    return bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge).start()


def snapshots(path: str) -> Callable[[DataFrame, int], None]:
    """A ``save`` for ``upsert_into``: every micro-batch is a folder of its own, and a repeated one replaces itself."""

    def save(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return save


def last_snapshot(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """The rows of the newest micro-batch that was written whole; ``fallback`` where there is none yet.

    A folder counts once its success mark is there, so a batch that died half way is never shown.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "batch=*/_SUCCESS")) or []
    numbers = [int(m.getPath().getParent().getName().split("=")[1]) for m in marks]
    return spark.read.parquet(f"{path}/batch={max(numbers)}") if numbers else fallback


def with_overrides(quotes: DataFrame, overrides: DataFrame) -> DataFrame:
    """A stream (or table) of quotes whose price gives way to that of ``overrides(symbol, price)``; a static side of a row a symbol."""
    given = overrides.select("symbol", F.col("price").alias("__given"))
    return quotes.join(given, "symbol", "left").withColumn("price", F.coalesce("__given", "price")).drop("__given")


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total, users`` by event-time window; runs on a stream or a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = rows.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.approx_count_distinct("user_id").alias("users"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total", "users")


def latch_stream(rows: DataFrame, on: float, off: float, key: str = "user_id", value: str = "value", forget_after: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``key, ts, state`` of a latch per key, kept between micro-batches; the batch form is ``islands.latch``.

    Rows of a key within a micro-batch are taken in the order of ``ts``.  With ``forget_after`` (such as ``30 days``) the state of a
    key that has had no row for so long is dropped, so the state store is bounded by the keys that are active.
    """
    keep_ms = int(pd.Timedelta(forget_after).total_seconds() * 1000) if forget_after else None

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for x in rows[value]:
            held = 1 if x >= on else -1 if x <= off else held
            out.append(held)
        state.update((held,))
        if keep_ms:
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame({key: [k[0]] * len(rows), "ts": rows["ts"].to_numpy(), "state": out})

    timed = rows.withWatermark("ts", late) if forget_after else rows
    kind = GroupStateTimeout.EventTimeTimeout if forget_after else GroupStateTimeout.NoTimeout
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} long, ts timestamp, state int", "held int", "append", kind)
