"""Small exact cases, the shipped golden numbers' rules, and invariants."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import EXECUTIONS, SIGNALS, SYMBOLS, Flow
from tidemark.functions import numeric as N
from tidemark.operators import align, eigen, folds, islands
from tidemark.operators import rolling as W
from tidemark.plans import backtest, engines, flow, newgate, report, search
from tidemark.plans import records as R
from tidemark.sources import ingest, sinks
from tidemark.streaming import quotes as stream

U = "universe"


def rows(spark, values, name="x", start=date(2024, 1, 1)):
    return spark.createDataFrame([("core", i, start + timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], f"universe string, idx int, d date, {name} double")


def values(df, c, order="idx"):
    return [r[c] for r in df.orderBy(order).select(c).collect()]


def panel(spark, n=90, seed=1, symbols=SYMBOLS):
    rng = random.Random(seed)
    out, price = [], dict.fromkeys(symbols, 100.0)
    for i in range(n):
        for s in symbols:
            opened = price[s] * math.exp(rng.gauss(0, 0.005))
            price[s] *= math.exp(rng.gauss(0.0005, 0.02))
            out.append(("core", s, date(2020, 1, 1) + timedelta(i), opened, price[s]))
    return spark.createDataFrame(out, "universe string, symbol string, d date, open double, close double")


def test_alignment_keeps_shared_days(spark):
    p = spark.createDataFrame([("core", "AAA", date(2024, 1, i + 1), None, v) for i, v in enumerate((100.0, 102.0, 101.0))] + [("core", "BBB", date(2024, 1, i + 2), None, v) for i, v in enumerate((99.0, 98.0, 100.0))], "universe string, symbol string, d date, open double, close double")
    a = align.align(p, ("AAA", "BBB"))
    assert [(r.symbol, r.idx, r.close) for r in a.orderBy("symbol", "idx").collect()] == [("AAA", 0, 102.0), ("AAA", 1, 101.0), ("BBB", 0, 99.0), ("BBB", 1, 98.0)]


def test_returns(spark):
    d = rows(spark, [100, 110, 121]).withColumn("r", W.log_return("x", W.series(U)))
    assert values(d, "r") == [None, pytest.approx(math.log(1.1)), pytest.approx(math.log(1.1))]


def test_exponential_mean(spark):
    d = folds.with_ema(rows(spark, [1, 2, 3, 4]), {"e": ("x", 2)})
    assert values(d, "e") == pytest.approx([1, 1.6666666666666665, 2.5555555555555554, 3.518518518518518])


def test_correlation_and_zero_variance(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    assert d.select(W.correlation("a", "b")).first()[0] == pytest.approx(1)
    assert d.select(W.correlation("a", "c"), W.correlation("a", "c", zero=None)).first()[:] == (0, None)


def test_stability_of_three(spark):
    c = spark.createDataFrame([("core", 0, date(2024, 1, 1), "IWM", "SPY", 0.8), ("core", 0, date(2024, 1, 1), "IWM", "TLT", -0.4), ("core", 0, date(2024, 1, 1), "SPY", "TLT", -0.5)], "universe string, idx int, d date, s1 string, s2 string, corr double")
    assert R.daily(c).first()["stability"] == pytest.approx(0.52)


def test_missing_values_stay_missing(spark):
    d = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in d.select(N.clamp01(N.finite("x"))).collect()] == [None, None, None, 1.0]
    assert [r[0] for r in d.select(N.normalize_range(N.finite("x"), 0, 4)).collect()] == [0, 0, 0, 0.5]


def test_golden_rules(spark):
    """Executed is the state a row before; returns are 3 x, 1 x and 0; equity compounds; drawdown is not above 0."""
    state = [1, 1, 0, -1, -1, 1, 0, 0, 1]
    close = [100, 101, 99, 98, 100, 103, 101, 102, 104]
    d = rows(spark, close, "close").withColumn("open", F.col("close")).join(spark.createDataFrame(list(enumerate(state)), "idx int, state int"), "idx")
    t = backtest.backtest(d, EXECUTIONS["golden"]).orderBy("idx").toPandas()
    assert t["executed"].tolist() == [0, *state[:-1]]
    r = np.array([0, *(np.diff(close) / np.array(close[:-1]))])
    want = r * t["executed"].map({1: 3, 0: 1, -1: 0})
    assert t["ret_strategy"].to_numpy() == pytest.approx(want.to_numpy())
    assert t["equity"].to_numpy() == pytest.approx(np.cumprod(1 + want))
    assert (t["dd"] <= 1e-12).all()


def test_latch_and_segments(spark):
    d = rows(spark, [0, 5, 3, 1, 3, 6, None, 1]).withColumn("s", islands.latch("x", 5, 1, W.series(U)))
    assert values(d, "s") == [-1, 1, 1, -1, -1, 1, 1, -1]
    seg = islands.segments(d, "s").orderBy("segment").collect()
    assert [(r.s, r.n) for r in seg] == [(-1, 1), (1, 2), (-1, 2), (1, 2), (-1, 1)]


def test_streak(spark):
    d = islands.with_streak(rows(spark, [1, 1, 0, 1, 1, 1]), F.col("x") > 0, "run")
    assert values(d, "run") == [1, 2, 0, 1, 2, 3]


def test_robust_deviation_forms_agree(spark):
    rng = np.random.default_rng(3)
    x = [None if i % 7 == 3 else float(v) for i, v in enumerate(rng.normal(size=60))]
    got = values(rows(spark, x).withColumn("m", W.mad_sigma("x", W.series(U), 12)), "m")
    want = folds.mad_values(pd.Series(x, dtype=float), 12)
    assert [g if g is not None else math.nan for g in got] == pytest.approx(want.tolist(), nan_ok=True)


def test_held_cap_and_countdowns():
    assert folds.held_cap(np.array([0, 1, 0, 0, 0, 1, 0]), np.array([0, 0, 0, 0, 0, 0, 1]), 3).tolist() == [0, 1, 1, 1, 0, 1, 1]
    c = folds.countdowns(np.array([1, 0, 0]), np.array([0, 1, 0]), np.array([1, 0, 0]), 2, 1, 2)
    assert c["up_lead"].tolist() == [2, 1, 0] and c["hazard"].tolist() == [2, 2, 1]


def test_eigen(spark):
    d = spark.createDataFrame([([0.5, 0.2, 0.1],), ([0.0, 0.0, 0.0],), (None,)], "u array<double>")
    got = [r[0] for r in d.select(eigen.absorption("u")).collect()]
    m = np.array([[1, 0.5, 0.2], [0.5, 1, 0.1], [0.2, 0.1, 1]])
    assert got[:2] == pytest.approx([np.linalg.eigvalsh(m)[-1] / 3, 1 / 3]) and got[2] is None
    v = np.array(d.select(eigen.first_component("u")).first()[0])
    assert v.sum() > 0 and m @ v == pytest.approx(np.linalg.eigvalsh(m)[-1] * v)


def test_softmax_weights(spark):
    a, b = N.softmax2(F.lit(1.0), F.lit(-1.0), 4.0, 0.1)
    x, y = spark.range(1).select(a, b).first()
    assert x + y == pytest.approx(1) and y >= 0.09


def test_states_and_ranges(spark):
    p = panel(spark, 150)
    rec = R.full_records(p, 20).persist()
    e = engines.enhanced(rec).toPandas()
    assert set(e["state"]) <= {-1, 0, 1} and e["guard"].between(0, 1).all() and e["mm"].between(1 / 5, 1).all()
    f = flow.flow(p, 20, Flow("stab")).toPandas()
    assert set(f["state"]) <= {-1, 0, 1} and f["j"].abs().max() <= 1 and f["pcon"].between(0, 1).all()
    rec.unpersist()


def test_causal_operators_keep_earlier_rows(spark):
    """More days never change the rows before, once thresholds are frozen."""
    long = panel(spark, 140)
    short = long.filter(F.col("d") < date(2020, 1, 1) + timedelta(110))
    for f in (lambda p: flow.flow(p, 20, Flow("exp"), at=(0.1, -0.08)), lambda p: newgate.newgate(p, "base")):
        a, b = (f(p).orderBy("idx").toPandas() for p in (short, long))
        assert a["state"].tolist() == b["state"].tolist()[: len(a)]


def test_decide_is_sticky():
    on, off = [True, True, True, False, False], [False, False, False, True, False]
    no = [False] * 5
    assert flow.decide(on, off, [2] * 5, [1] * 5, no, no) == [0, 1, 1, -1, -1]
    assert flow.decide(on, off, [2] * 5, [1] * 5, [False, False, True, False, False], no) == [0, 1, -1, -1, -1]


def test_bayes_and_platt(spark):
    r = spark.createDataFrame([("f", float(x), int(x > 3)) for x in range(8)], "feature string, x double, up int")
    m = report.fit_bayes(r).first()
    assert (m.mu_up, m.mu_dn, m.prior_up) == (5.5, 1.5, 0.5)
    scored = report.posterior(report.drivers(spark.createDataFrame([("f", 5.0)], "feature string, x double"), report.fit_bayes(r)))
    assert 0.5 < scored.first()["p_up"] <= 1
    a, b = report.fit_platt(spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)], "p double, y int"), steps=20)
    assert a > 1 and abs(b) < 0.1


def test_search_ranks_candidates(spark):
    s = spark.createDataFrame([("core", 0, 0.1), ("core", 1, 0.3), ("core", 2, 0.3)], "universe string, candidate long, log_equity double")
    assert search.best(s).first()["candidate"] == 1
    a = search.random_candidates(spark, 3, seed=5, k=(0.0, 1.0)).collect()
    assert a == search.random_candidates(spark, 3, seed=5, k=(0.0, 1.0)).collect()


def test_history_drops_uneven_assets(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"assets": [{"symbol": "A", "dates": ["2024-01-01", "2024-01-02"], "prices": [1.0, 2.0], "opens": [null, 1.5]}, {"symbol": "B", "dates": ["2024-01-01"], "prices": [1.0, 2.0]}]}')
    got = [(r.symbol, r.open, r.close) for r in ingest.history(spark, str(tmp_path / "h.json")).orderBy("d").collect()]
    assert got == [("A", 1.0, 1.0), ("A", 1.5, 2.0)]


def test_text_table_and_overrides(spark):
    t = ingest.text_table(spark.createDataFrame([("2024-01-01\t0.5x\t\t-0.1",), ("date\tstability",), ("2024-01-02\t.4\t0.3\t0",)], "value string"))
    assert [(r.stability, r.smoothed) for r in t.orderBy("d").collect()] == [(0.5, 0.5), (0.4, 0.3)]
    o = ingest.overrides(spark.createDataFrame([('{"qqq": 1.5, "spy": "n/a", "iwm": "2"}',), (None,), ("{bad",)], "value string"))
    assert {(r.symbol, r.price) for r in o.collect()} == {("QQQ", 1.5), ("IWM", 2.0)}


def fetched(symbol, start, end):
    yield symbol, "2024-01-01", 1.0, 2.0, 1.0, None, 0
    yield symbol, "2024-01-01", 1.0, 2.0, 4.0, None, 1


def test_bar_source(spark):
    spark.dataSource.register(ingest.BarSource)
    src = spark.read.format("daily_bars").options(symbols="A,B", fetch="json:dumps").load()
    assert src.rdd.getNumPartitions() == 2
    bars = ingest.vendor_bars(spark.createDataFrame(list(fetched("A", None, None)), ingest.BarSource.schema(None)))
    assert [(r.open, r.close) for r in bars.collect()] == [(2.0, 4.0)]


def test_tickers_and_holdings(spark):
    t = ingest.tickers(spark.createDataFrame([("aapl, msft  msft brk.b toolongsymbol1",)], "value string")).first()["tickers"]
    assert t == ["AAPL", "MSFT", "BRK.B"]
    a = spark.createDataFrame([("x", 2), ("Y", 1)], "symbol string, position int")
    assert {(r.symbol, r.basket, r.position) for r in ingest.holdings(a, a.limit(1)).collect()} == {("X", 0, 2), ("Y", 0, 1)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(30, 1.23456789)], "window int, x double")
    sinks.write_records(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_records(df, str(tmp_path / "r"))
    sinks.write_manifest(spark, str(tmp_path / "m"), "no_data", rows=0)
    with pytest.raises(ValueError):
        sinks.read_manifest(spark, str(tmp_path / "m"))
    lines = sinks.report_lines(prices=spark.createDataFrame([(1, "a")], "number int, line string")).orderBy("section", "number").collect()
    assert [r.line for r in lines] == ["[prices]", "a"]


def test_stream_upsert_and_latch(spark, tmp_path):
    src = tmp_path / "in"
    q = spark.createDataFrame([("A", "2024-01-01 10:00:00", 1.0), ("A", "2024-01-01 11:00:00", 3.0), ("A", "2024-01-02 09:00:00", 4.0)], "symbol string, ts string, price double").withColumn("ts", F.to_timestamp("ts"))
    q.coalesce(1).write.parquet(str(src))
    bars = stream.latest_bars(spark.readStream.schema(q.schema).parquet(str(src)))
    old = spark.createDataFrame([("core", "A", date(2024, 1, 1), 0.5, 0.7)], "universe string, symbol string, d date, open double, close double")
    out = str(tmp_path / "out")
    run = stream.upsert_into(bars, lambda: old, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "cp"))
    run.processAllAvailable()
    run.stop()
    got = {(str(r.d), r.open, r.close) for r in spark.read.parquet(f"{out}/0").collect()}
    assert got == {("2024-01-01", 0.5, 3.0), ("2024-01-02", None, 4.0)}
    ev = spark.createDataFrame([(1, "2024-01-01 10:00:00", 70.0), (1, "2024-01-01 11:00:00", 30.0), (2, "2024-01-01 10:00:00", 5.0)], "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = stream.latch_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), 60, 10).writeStream.format("memory").queryName("latch").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    s.processAllAvailable()
    s.stop()
    assert {(r.user_id, r.state) for r in spark.table("latch").collect()} == {(1, 1), (2, -1)}


def test_signals_are_five():
    assert len(SIGNALS) == 5


def test_csv_has_a_folder_for_each_universe(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(spark.createDataFrame([(u, f"2020-01-{d:02d}") for d in (3, 1, 2) for u in "ab"], "universe string, date string").repartition(5), path)
    files = {p.parent.name: p.read_text().split() for p in (tmp_path / "csv").glob("universe=*/*.csv")}
    assert files == {f"universe={u}": ["date", "2020-01-01", "2020-01-02", "2020-01-03"] for u in "ab"}
