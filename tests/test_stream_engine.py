"""The flow engine on a stream gives the days of the batch engine, over many micro-batches and a restart."""

import pytest
from pyspark.sql import functions as F

from tidemark.config import Flow, Stab
from tidemark.plans import flow, frame
from tidemark.streaming import engine
from test_units import panel

U = "universe"


@pytest.fixture(scope="module")
def days(spark):
    p = panel(spark, 330, 3).withColumn(U, F.lit("a")).unionByName(panel(spark, 300, 4).withColumn(U, F.lit("b"))).persist()
    return p, flow.day_columns(frame.inputs(p, 20)).persist()


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", engine.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def loose(variant):
    """Parameters with which made-up prices reach all states."""
    return Flow(variant, q_on=0.6, q_off=0.4, j_on=0.0, j_off=0.0, stab=Stab(fast=3, slow=10, z_win=40, z_up=1.0, z_down=1.0, slope_min=0.001, lag_up=2, lag_down=2))


@pytest.mark.parametrize("variant", ["stab", "exp"])
def test_stream_equals_batch(spark, days, tmp_path, variant):
    """Ten micro-batches of days, the query started anew for each two, the last batch read twice."""
    p = loose(variant)
    cols = flow.columns(days[0], 20).persist()
    fitted = flow.fit(cols, p).persist()
    want = {(r[U], r.idx): (r.state, r.executed, round(r.j, 9), round(r.guard, 9)) for r in flow.decided(cols, p, fitted).collect()}
    source, rows = str(tmp_path / "days"), days[1]
    for k in range(10):
        rows.filter(f"idx >= {33 * k} and idx < {33 * (k + 1)}").coalesce(1).write.mode("append").parquet(source)
        if k == 9:
            rows.filter("idx >= 297").coalesce(1).write.mode("append").parquet(source)  # the same days again
        if k % 2:
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
            q = engine.flow_stream(stream, fitted, p).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
            q.processAllAvailable()
            q.stop()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r[U], r.idx): (r.state, r.executed, round(r.j, 9), round(r.guard, 9)) for r in out}
    assert len(out) == len(got) == len(want)
    early = lambda k: k[1] - 20 < 252  # noqa: E731  the guard's spread looks back over a part of the history in batch
    assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
    assert {k: v for k, v in got.items() if not early(k)} == {k: v for k, v in want.items() if not early(k)}
    assert len({v[0] for v in got.values()}) >= 2


def test_means_are_carried(days):
    """A memory that is taken apart and put together after every day goes on as one that is not."""
    for variant in ("stab", "exp", "classic"):
        p = loose(variant)
        rows = days[1].filter(f"{U} = 'b'").orderBy("idx").toPandas()[["stability", "frob", "flux_raw", "mm", "v_pc1", "r_QQQ", "r_IWM", "r_BTC_USD"]].astype(float).to_dict("records")[:120]
        whole, parts, out = engine.Memory(p), None, []
        for r in rows:
            m = engine.Memory(p, *(parts or ()))
            out.append(m.step(r))
            parts = (m.numbers, m.frob, m.trend)
        assert str(out) == str([whole.step(r) for r in rows])


def test_state_of_a_silent_universe_is_forgotten(spark, days, tmp_path):
    """After its time a universe starts anew: the same early days are taken again.  Timers keep such a query going, so it is stopped by hand."""
    import time

    p = loose("classic")
    source, rows = str(tmp_path / "days"), days[1].filter(f"{U} = 'a' and idx < 40").coalesce(1)
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    q = engine.flow_stream(stream, (0.1, -0.08), p, forget_after="15 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    counts = []
    try:
        for k in range(3):
            for _ in range(120):
                if sum(x["numInputRows"] for x in q.recentProgress) >= 40 * (k + 1):
                    break
                assert q.exception() is None
                time.sleep(0.5)
            counts.append(spark.read.parquet(str(tmp_path / "out")).count())
            if k == 1:
                time.sleep(20)
            if k < 2:
                rows.write.mode("append").parquet(source)
    finally:
        q.stop()
    assert counts[0] == counts[1] > 15 and counts[2] == 2 * counts[0]
