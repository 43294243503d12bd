"""Versions with marks, and the panel that is merged by months."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.plans import flow, frame
from tidemark.sources.versions import Versions
from tidemark.streaming import panel as store_module
from tidemark.streaming.panel import PanelStore
from test_units import panel

U = "universe"


def plain(df):
    return sorted((r[U], r.symbol, r.d, r.open, r.close) for r in df.collect())


def test_a_reader_keeps_its_version(spark, tmp_path):
    """Across a write a reader has the old rows; a writer that dies before its mark changes nothing; old versions go after the grace."""
    v = Versions(spark, str(tmp_path / "t"))
    assert v.current() is None
    with pytest.raises(ValueError, match="no version"):
        v.read()
    one = spark.createDataFrame([(1,)], "x int")
    assert v.publish(one, "2024-01-01 10:00:00") == 0
    reader = v.read()
    assert v.publish(one.withColumn("x", F.lit(2))) == 1
    assert reader.first().x == 1 and v.read().first().x == 2 and v.read(0).first().x == 1
    one.withColumn("x", F.lit(9)).write.parquet(str(tmp_path / "t" / "v=2"))  # written, never marked
    assert v.current() == 1 and v.read().first().x == 2
    assert v.publish(one.withColumn("x", F.lit(3))) == 3 and v.read().first().x == 3
    assert v.clear(grace=3600) == [] and reader.first().x == 1
    import time

    assert sorted(v.clear(grace=60, now=time.time() + 3600)) == [0, 1, 2] and v.read().first().x == 3
    with pytest.raises(ValueError, match="no version 1"):
        v.read(1)


def test_two_writers_of_one_version(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    v.publish(spark.range(1))
    with pytest.raises(Exception, match="(?i)exist"):
        v.files.mark("marks/0")


@pytest.fixture(scope="module")
def bars(spark):
    p = panel(spark, 130, 6).withColumn(U, F.lit("a")).unionByName(panel(spark, 100, 7).withColumn(U, F.lit("b")))
    return p.persist()


def quoted(rows):
    return rows.select(U, "symbol", "d", F.col("close").alias("price"))


def test_merged_months_equal_the_whole_panel(spark, bars, tmp_path):
    """Three batches, one again and one that died: rows, parts and the recomputed days are those of a full run."""
    store = PanelStore(spark, str(tmp_path / "p"))
    days = sorted(r.d for r in bars.select("d").distinct().collect())
    cut = days[100]
    assert store.read().count() == 0
    assert store.merge(quoted(bars.filter(F.col("d") < cut)), 0)
    later = quoted(bars.filter(F.col("d") >= cut))
    fixed = spark.createDataFrame([("a", "IWM", days[60], 77.0)], f"{U} string, symbol string, d date, price double")
    assert store.merge(later, 1) and not store.merge(later.withColumn("price", F.lit(0.0)), 1)
    # A batch that wrote its parts and no mark.
    quoted(bars).withColumn("price", F.lit(1.0)).withColumn("month", store_module.month()).select("symbol", "d", F.lit(None).cast("double").alias("open"), F.col("price").alias("close"), U, "month").write.partitionBy(U, "month").parquet(str(tmp_path / "p" / "parts" / "batch=7"))
    before = store.read()
    assert store.merge(fixed, 2)
    want = align.upsert(align.upsert(bars.limit(0), quoted(bars)), fixed)
    assert plain(store.read()) == plain(want) and plain(store.read(1)) == plain(align.upsert(bars.limit(0), quoted(bars)))
    touched = [str(f.parent.relative_to(tmp_path / "p" / "parts" / "batch=2")) for f in (tmp_path / "p" / "parts" / "batch=2").glob("*/*/*.parquet")]
    assert set(touched) == {f"{U}=a/month={days[60]:%Y-%m}"}  # one quote rewrites one part
    again = store.days_again(2, 20).orderBy("idx").toPandas()
    full = flow.day_columns(frame.inputs(want, 20)).filter((F.col(U) == "a") & (F.col("d") >= F.lit(days[60]))).orderBy("idx").toPandas()
    assert again["idx"].tolist() == full["idx"].tolist() and again["d"].tolist() == full["d"].tolist() and len(full) > 60
    for c in ("stability", "pair_corr", "mm", "flux_raw", "frob", "z_IWM", "bench20", "r_QQQ", "combo", "breadth"):
        assert again[c].to_numpy(float) == pytest.approx(full[c].to_numpy(float), abs=1e-9, nan_ok=True), c
    assert store.clear(keep=1) == 2 and plain(store.read()) == plain(want)  # the months that batches 1 and 2 replaced
    del before


def test_quotes_stream_into_the_store(spark, tmp_path):
    """Repeats pass once, corrections replace, a restart goes on."""
    store, source = PanelStore(spark, str(tmp_path / "p")), str(tmp_path / "in")
    schema = f"{U} string, symbol string, d date, ts timestamp, price double"
    day = date(2024, 3, 4)
    batches = [
        [("a", "QQQ", day, "2024-03-04 10:00:00", 1.0), ("a", "QQQ", day, "2024-03-04 10:00:00", 1.0), ("a", "IWM", day, "2024-03-04 10:00:00", 2.0)],
        [("a", "QQQ", day, "2024-03-04 10:00:00", 1.0), ("a", "IWM", day, "2024-03-04 11:00:00", 3.0)],
        [("a", "QQQ", day + timedelta(30), "2024-04-03 10:00:00", 5.0)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, f"{U} string, symbol string, d date, ts string, price double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = store_module.last_wins(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.foreachBatch(lambda b, n: store.merge(b, n) and None).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert {(r.symbol, r.d, r.close) for r in store.read().collect()} == {("QQQ", day, 1.0), ("IWM", day, 3.0), ("QQQ", day + timedelta(30), 5.0)}
    assert store.log().filter("month = '2024-04'").count() == 1
