"""Writers: partitioned tables with a manifest, backtest CSV, report lines, append-only history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import fixed, printf

def write_records(records: DataFrame, path: str, partition: str = "window", force: bool = False) -> None:
    """Parquet by partition; refuses to overwrite unless forced."""
    records.write.mode("overwrite" if force else "errorifexists").partitionBy(partition).parquet(path)


def write_manifest(spark: SparkSession, path: str, status: str, **facts: str) -> None:
    """One row ``status`` (``ok`` or ``no_data``) with its facts, as JSON."""
    row = spark.createDataFrame([(status, *map(str, facts.values()))], "status string" + "".join(f", {k} string" for k in facts))
    row.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; raises where there are no data, so no caller works on an empty table."""
    rows = spark.read.json(path)
    if rows.filter("status != 'ok'").take(1):
        raise ValueError(f"{path}: no data")
    return rows


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c, t in rows.dtypes if t == "double"})


def backtest_columns(tested: DataFrame, *keep: str) -> DataFrame:
    """``date, regime, executed``, returns and equities of a backtest, and prices and the levered equity where it has them."""
    more = [(c, out) for c, out in (("open", "price_qqq"), ("levered_open", "price_tqqq"), ("equity_levered", "eq_tqqq")) if c in tested.columns]
    return tested.select(
        *keep, F.col("d").cast("string").alias("date"), F.col("state").alias("regime"), "executed", F.col("ret").alias("ret_bench"), "ret_strategy", F.col("equity").alias("eq_strategy"), F.col("equity_bench").alias("eq_benchmark"),
        *(F.col(c).alias(out) for c, out in more),
    )


def backtest_csv(tested: DataFrame) -> DataFrame:
    """``backtest_columns`` with its numbers as text of 8 decimals."""
    d = backtest_columns(tested)
    return d.withColumns({c: fixed(c, 8, "") for c, t in d.dtypes if t == "double"})


def write_csv(rows: DataFrame, path: str, order: str = "date") -> None:
    """One file a universe of daily rows, in order; a series is bounded by its calendar."""
    if "universe" in rows.columns:
        rows.repartition("universe").sortWithinPartitions("universe", order).write.mode("overwrite").partitionBy("universe").csv(path, header=True)
    else:
        rows.orderBy(order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_lines(**sections: DataFrame) -> DataFrame:
    """``section, number, line`` of titled sections, each a DataFrame ``number, line``, in the order given."""
    out = None
    for i, (title, rows) in enumerate(sections.items()):
        spark = rows.sparkSession
        head = spark.range(1).select(F.lit(i).alias("section"), F.lit(-1).cast("long").alias("number"), F.lit(f"[{title.replace('_', ' ')}]").alias("line"))
        body = rows.select(F.lit(i).alias("section"), F.col("number").cast("long").alias("number"), "line")
        both = head.unionByName(body)
        out = both if out is None else out.unionByName(both)
    return out


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """``section, number, line`` as one text file; a report is bounded by its calendar."""
    lines.coalesce(1).sortWithinPartitions("section", "number").select("line").write.mode("overwrite").text(path)


def write_model(model: DataFrame, path: str, calibration: tuple[float, float], ts: str) -> None:
    """``report.fit_bayes`` and the calibration as one JSON row, arrays in the model's feature order; ``ingest.model`` reads it."""
    from tidemark.plans.report import FEATURES

    at = F.array_position(F.array(*map(F.lit, FEATURES)), F.col("feature"))
    held = F.array_sort(F.collect_list(F.struct(at.alias("at"), "mu_up", "var_up", "mu_dn", "var_dn")))
    row = model.agg(held.alias("m"), F.max("prior_up").alias("prior_up"))
    row.select(*(F.col(f"m.{c}").alias(c) for c in ("mu_up", "var_up", "mu_dn", "var_dn")), "prior_up", F.array(*map(F.lit, calibration)).alias("calib"), F.lit(ts).alias("ts")).coalesce(1).write.mode("overwrite").json(path)


def write_tuning(parameters: DataFrame, path: str) -> None:
    """Found parameters, a JSON row a universe: ``cycle`` and a struct ``stab_tune`` of the rest."""
    rest = [c for c in parameters.columns if c not in ("universe", "cycle")]
    parameters.select("universe", "cycle", F.struct(*rest).alias("stab_tune")).coalesce(1).write.mode("overwrite").json(path)


def report_summary(report: DataFrame, top: DataFrame, k: int = 5) -> DataFrame:
    """``universe, number, line``: the probability in percent and the ``k`` strongest drivers."""
    named = top.filter(F.col("rank") <= k).groupBy("universe").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature", "llr"))), lambda x: printf("%s:%+.3f", x["feature"], x["llr"])), ", ").alias("drivers"))
    lines = F.array(printf("Upward probability: %.2f%%", F.col("p_up") * 100), F.concat(F.lit("Top drivers: "), F.coalesce("drivers", F.lit(""))))
    return report.join(named, "universe", "left").select("universe", F.posexplode(lines).alias("number", "line"))


def write_snapshot(rows: DataFrame, path: str, as_of: str) -> None:
    """A cache that ``ingest.cached`` reads, with the time it is true for."""
    rows.withColumn("as_of", F.lit(as_of).cast("timestamp")).write.mode("overwrite").parquet(path)


def write_favorites(symbols: DataFrame, path: str, most: int = 20) -> None:
    """Distinct well-formed symbols in capitals, the first ``most`` by their ``position``."""
    from tidemark.sources.ingest import TICKER

    kept = symbols.select(F.upper(F.trim("symbol")).alias("symbol"), "position").filter(F.col("symbol").rlike(TICKER)).groupBy("symbol").agg(F.min("position").alias("position"))
    kept.orderBy("position", "symbol").limit(most).coalesce(1).write.mode("overwrite").json(path)
