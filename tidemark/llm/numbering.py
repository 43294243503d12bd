"""A number for every row in a total order, without bringing the rows into one task.

Rows are dealt by ranges of the order and sorted inside each range; a row's place in its range is known to its own
task, and only one row a range (or a range and group) is summed up.  The dealt table is written, so the places
survive lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import workspace

#: ``monotonically_increasing_id`` puts the partition above these bits and the row's place below.
_PLACE = 33


def dealt(df: DataFrame, order: list[Column], name: str, per_range: int = 1_000_000) -> DataFrame:
    """``df``, written, with ``range`` and ``place``: rows ascend by ``order`` over ranges, then places from 0.

    The order should tell different rows apart, or many equal rows share a range; about ``per_range`` rows
    make a range.
    """
    spark = df.sparkSession
    parts = workspace.parts_for(df.count(), per_range, spark.sparkContext.defaultParallelism)
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumns({"range": F.shiftright("at", _PLACE).cast("int"), "place": F.col("at").bitwiseAND(F.lit((1 << _PLACE) - 1))})
    return workspace.written(rows.drop("at"), name)


def offsets(rows: DataFrame) -> DataFrame:
    """``range, before``: the rows in all earlier ranges; as many rows as there are ranges."""
    sizes = rows.groupBy("range").agg(F.count("*").alias("size"))
    return sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))


def numbered(rows: DataFrame, number: str) -> DataFrame:
    """Dealt ``rows`` with ``number``: 0, 1, 2 ... in their order, in place of ``range`` and ``place``."""
    return rows.join(F.broadcast(offsets(rows)), "range").withColumn(number, F.col("before") + F.col("place")).drop("range", "place", "before")


def numbered_within(rows: DataFrame, group: str, number: str, size: str, rank: str) -> DataFrame:
    """Dealt ``rows``, ordered by ``group`` first, with ``number`` from 0 in each group, the group's ``size`` and its own ``rank`` from 0.

    A large group meets its start by range and group, so no key has more rows than a range.
    """
    before = offsets(rows)
    pieces = rows.groupBy("range", group).agg(F.min("place").alias("first"), F.count("*").alias("rows")).join(F.broadcast(before), "range")
    pieces = workspace.written(pieces.select("range", F.col(group).alias("of"), "before", (F.col("before") + F.col("first")).alias("first"), "rows"), "pieces")
    groups = pieces.groupBy("of").agg(F.min("first").alias("start"), F.sum("rows").alias(size))
    groups = numbered(dealt(groups.withColumnRenamed("of", "whole"), [F.col("start")], "groups"), rank)
    starts = pieces.join(groups, F.col("of").eqNullSafe(F.col("whole"))).select(F.col("range").alias("in_range"), "whole", (F.col("before") - F.col("start")).alias("shift"), size, rank)
    met = rows.join(starts, (F.col("range") == F.col("in_range")) & F.col(group).eqNullSafe(F.col("whole")))
    return met.withColumn(number, F.col("shift") + F.col("place")).drop("range", "place", "in_range", "whole", "shift")
