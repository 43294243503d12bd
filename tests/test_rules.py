"""Rules worked out by hand: the golden backtest, overrides, objectives, runners, snapshots, texts, streams."""

import math
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import EXECUTIONS, NEWGATE, Flow, Stab
from tidemark.functions import numeric as N
from tidemark.operators import align, filters, folds
from tidemark.plans import backtest, flow, flux5, frame, narrative, newgate, report, search, sections, snapshot
from tidemark.plans import records as R
from tidemark.sources import ingest, sinks
from tidemark.streaming import quotes as stream
from test_units import panel

U = "universe"

def test_golden_backtest(spark):
    """The shipped backtest: states a row late, 3 x, 1 x and 0 of the return, equities, drawdowns, counts."""
    shipped = pd.read_csv(Path(__file__).parent / "golden_backtest.csv", comment="#")
    state, ret = shipped["regime"].tolist(), shipped["ret_bench"].tolist()
    assert len(state) == len(ret) == 180 and shipped["date"].iloc[[0, -1]].tolist() == ["2025-05-05", "2025-10-31"]
    close = np.cumprod([1.0, *(1 + r for r in ret)]).tolist()
    # A neutral day before the first one gives the first return its base.
    rows = [("core", i, date(2025, 5, 4) + timedelta(i), s, c, c) for i, (s, c) in enumerate(zip([0, *state], close))]
    d = spark.createDataFrame(rows, "universe string, idx int, d date, state int, open double, close double")
    t = backtest.backtest(d, EXECUTIONS["golden"])
    p = t.orderBy("idx").toPandas()
    assert p["executed"].tolist()[1:] == [0, *state[:-1]] and p["d"].iloc[-1] == date(2025, 10, 31)
    assert p["ret"].to_numpy()[1:] == pytest.approx(ret, abs=1e-8)
    assert p["equity"].iloc[-1] == pytest.approx(1.40771157, abs=2e-7) and p["equity_bench"].iloc[-1] == pytest.approx(1.29428107, abs=2e-7)
    assert p["dd"].min() == pytest.approx(-0.127824, abs=2e-6) and (p["equity_bench"] / p["equity_bench"].cummax() - 1).min() == pytest.approx(-0.035883, abs=2e-6)
    assert [state.count(s) for s in (1, -1, 0)] == [93, 67, 20] and sum(a != b for a, b in zip(state, state[1:])) == 34
    assert backtest.statistics(t.filter("idx > 0")).first()["transitions"] == 34


def test_frame_equals_pair_rows(spark):
    """The frame's columns are those of the pair rows."""
    p = panel(spark, 80).persist()
    f = frame.daily(p, 20).orderBy("idx").toPandas()
    corr = R.rolling_correlation(R.pairs_of(R.with_returns(R.wide_aligned(p)), "r"), 20).drop("x", "y")
    rec = R.smoothed(R.daily(corr)).join(R.absorption(corr.filter(~F.col("s1").isin("QQQ") & ~F.col("s2").isin("QQQ")), tuple(s for s in ("IWM", "SPY", "TLT", "GLD", "BTC-USD"))).select(U, "idx", "mm"), [U, "idx"])
    flux = flow.pair_flux(corr, flow.momenta(p)).drop("d")
    want = rec.join(flux, [U, "idx"]).orderBy("idx").toPandas()
    assert f["idx"].tolist() == want["idx"].tolist()
    for c in ("stability", "stock_crypto", "traditional", "safe_negative", "pair_corr", "smoothed", "delta", "mm", "flux_raw", "intensity", "apdf", "pcon", "rb"):
        assert f[c].to_numpy() == pytest.approx(want[c].to_numpy(), abs=1e-9, nan_ok=True), c
    damp = folds.bear_damp(align.align(p)).orderBy("idx").toPandas()
    assert f["damp"].to_numpy() == pytest.approx(damp["damp"].to_numpy()[-len(f) :])
    p.unpersist()


def test_overrides_of_guarded_states(spark):
    """Two rising rows open a lead of three; two falling rows a grace of two, then a hazard of two."""
    assert {k: v.tolist() for k, v in folds.opened(np.array([0, 1, 0, 0, 0, 0]), np.zeros(6), 3, 2, 2).items()} == {"up_lead": [0, 1, 1, 1, 0, 0], "hazard": [0] * 6}
    assert folds.opened(np.zeros(7), np.array([0, 1, 0, 0, 0, 0, 0]), 3, 2, 2)["hazard"].tolist() == [0, 0, 0, 1, 1, 0, 0]
    rng = np.random.default_rng(5)
    s = np.concatenate([rng.normal(0.5, 0.002, 40), 0.5 + np.linspace(0, 0.3, 12), rng.normal(0.8, 0.002, 30), 0.8 - np.linspace(0, 0.4, 14), rng.normal(0.4, 0.002, 10)])
    rows = [("core", i, -1 if i < 70 else 1, float(x), 0.01 if i % 2 else -0.01) for i, x in enumerate(s)]
    d = narrative.guarded(spark.createDataFrame(rows, "universe string, idx int, state int, stability double, ret5 double"), Stab(fast=3, slow=10, z_win=30, z_up=2.0, z_down=2.0, slope_min=0.01, lag_up=2, lag_down=2, lead_on=3, down_grace=2, hazard=3)).orderBy("idx").toPandas()
    lead, hazard = d["up_lead"] == 1, d["hazard"] == 1
    assert lead.any() and hazard.any()
    assert (d["guarded"][(d["state"] > 0) & hazard] == 0).all() and (d["guarded"][(d["state"] < 0) & lead & (d["ret5"] > 0)] == 1).all()
    same = ~(((d["state"] > 0) & hazard) | ((d["state"] < 0) & lead & (d["ret5"] > 0)))
    assert (d["guarded"][same] == d["state"][same]).all() and d["guarded_executed"].tolist() == [0, *d["guarded"][:-1]]


def test_objectives(spark):
    s = spark.createDataFrame([(0, 252, math.log(1.2), 0.20, -0.50, 0.6, 0.55, 10.0, 10), (1, 252, math.log(0.9), -0.10, 0.0, 0.0, None, 0.0, 0)], "candidate long, n long, log_equity double, cagr double, max_drawdown double, hit_rate double, on_hit_rate double, churn double, transitions long")
    got = [r.objective for r in search.objective_blended(s).orderBy("candidate").collect()]
    assert got == pytest.approx([0.6 + 0.3 - 1.2 * 0.05 - 0.1, -0.3 + 0.225 - 1.2 * 0.55 - 0.2])
    got = [r.objective for r in search.objective_exp(s).orderBy("candidate").collect()]
    assert got == pytest.approx([0.2 + 0.3 * 0.05 - 0.2 - 0.2 * 10 / 252, -0.1 - 0.15])
    one = search.objective_segments(s.withColumn("candidate", F.lit(7))).first()
    assert one.objective == pytest.approx(math.log(math.sqrt(1.2 * 0.9)) + 0.4 * (0.275 - 0.5) - 0.4 * 0.25 - 0.15 * 10 / 504)


def test_searches_have_their_axes():
    assert len(search.grid(**search.FLUX5_GRID)) == 864 and len(search.grid(**search.EXP_GRID)) == 8
    a, b = search.drawn_stab(5, 30, 42), search.drawn_stab(5, 30, 42)
    assert a == b and all(7 <= c["fast"] <= 42 and c["slow"] >= max(2 * c["fast"], 30) and 1.4 <= c["z_up"] <= 2.2 for c in a)
    assert all(c["q_off"] < c["q_on"] - 0.08 for c in search.drawn_exp(50))
    draw = N.mulberry32(42)
    assert [round(next(draw), 6) for _ in range(3)] == [0.601104, 0.448291, 0.852466]


def test_parameters_of_flux5_matter(spark):
    """Each parameter changes a state somewhere in random inputs, and the drift rule follows its own."""
    import pandas as pd

    rng = np.random.default_rng(9)
    n = 4000
    pdf = pd.DataFrame({"down_all": rng.choice([0.2, 0.4, 0.6, 0.625], n), "flux_norm": rng.normal(0.3, 0.3, n), "diffusion": rng.normal(0.3, 0.2, n), "kappa": rng.uniform(0.4, 0.8, n), "pcon": rng.uniform(0.35, 0.9, n), "mm_six": rng.uniform(0.5, 0.93, n), "v_six": rng.normal(0.1, 0.1, n), "pair_corr": rng.uniform(-0.2, 0.6, n), "spy_tlt": rng.uniform(-0.5, 0.2, n), "bench20": rng.normal(0.02, 0.03, n)})
    base = flux5.fold(pdf)
    assert set(base) == {-1, 0, 1} or set(base) == {-1, 1}
    for k, v in (("v_on", 0.10), ("v_off", -0.15), ("pcon_on", 0.65), ("pcon_off", 0.5), ("mm_hi", 0.92), ("down_all", 0.65), ("drift_days", 1), ("k_on", 0.65), ("lock_days", 9)):
        assert flux5.fold(pdf, **{k: v}) != base, k
    calm = pdf.iloc[:10].assign(down_all=0.0, mm_six=0.5, flux_norm=0.5, diffusion=0.5, kappa=0.7, pcon=0.7, v_six=0.2)
    assert flux5.fold(calm) == [0] * 10  # no entry before three days off
    fall = calm.assign(down_all=[1.0] * 4 + [0.0] * 6, flux_norm=[-1.0] * 4 + [0.5] * 6)
    assert flux5.fold(fall) == [0, 0, -1, -1, -1, -1, 1, 1, 1, 1]


def test_presets(spark):
    assert set(NEWGATE) == {"base", "defensive", "defensive_plus", "balanced", "balanced_plus", "aggressive", "aggressive_plus"}
    d = spark.createDataFrame([("core", i, 0.8, 1.0, 0, 0, 0, mm, j, g) for i, (mm, j, g) in enumerate([(0.5, 0.5, 0.1), (0.97, 0.5, 0.1), (0.5, -0.1, 0.1), (0.9, 0.5, 0.1), (0.5, 0.5, 0.96), (None, None, None)])], "universe string, idx int, pos_mix double, shock double, ew_hits int, dr_hits int, cr_held int, flow_mm double, flow_j double, flow_guard double").withColumn("w_trend", F.lit(0.5))
    got = [r.position for r in newgate.decided(d, NEWGATE["defensive_plus"]).orderBy("idx").collect()]
    assert got == pytest.approx([0.8, 0.16, 0.16, 0.32, 0.32, 0.8])
    assert [r.position for r in newgate.decided(d, NEWGATE["defensive"]).orderBy("idx").collect()] == pytest.approx([0.8] * 6)


def test_weak_days_have_no_upper_bound(spark):
    d = spark.createDataFrame([(1, 0.87), (1, 0.88), (0, 0.99), (0, None), (-1, 0.99)], "state int, guard double")
    assert [r.f for r in d.select(flow.fragile("state", "guard").alias("f")).collect()] == [False, True, True, True, False]


def test_divergences_and_texts(spark):
    d = spark.createDataFrame([(1, 0.6, 0.36, 1.0, 0.1), (2, 0.4, 0.2, 1.9, -1.0), (3, 0.7, 0.4, None, -0.1), (4, 0.5, None, None, None)], "idx int, p_up double, rv20 double, adr double, spr_10y_3m double")
    got = {r.idx: len(r.rules) for r in report.divergences(d).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 0}
    heads = spark.createDataFrame([(0.65,), (0.55,), (0.451,), (0.45,)], "p double").select(report.headline(F.col("p"))).collect()
    assert [h[0] for h in heads] == ["Strong upside bias", "Mild upside bias", "Balanced", "Downside bias"]
    top = spark.createDataFrame([(3, 1, "NH/NL", 9.0, -0.5), (3, 2, "RV20", 0.3, 0.1), (3, 3, "ADR", None, 0.0)], "idx int, rank int, feature string, x double, llr double")
    notes = report.driver_notes(top, spark.createDataFrame([(3, 0.3, 1.6)], "idx int, p_up double, adr double")).orderBy("rank").collect()
    assert [n.rank for n in notes] == [1, 2, 99] and "bound 8.0" in notes[0].note and "calm" in notes[1].note and "participation lives" in notes[2].note
    lines = report.summary_lines(d.filter("idx = 3").select("idx", "p_up"), top, top.select("idx", "feature", "x")).orderBy("number").collect()
    assert [x.line for x in lines] == ["- Conclusion: Strong upside bias, P(up)=70.0%", "- Drivers: NH/NL(-0.500), RV20(+0.100), ADR(+0.000)", "- Macro: RV20=0.300", "- Breadth: NH/NL=9.00"]


def test_sessions_and_two_sources(spark):
    t = spark.createDataFrame([(datetime(2024, 1, 5, 14, 29),), (datetime(2024, 1, 5, 14, 30),), (datetime(2024, 7, 5, 20, 0),)], "ts timestamp")
    assert [r[0] for r in t.select(N.session_of("ts")).collect()] == ["pre", "regular", "post"]
    none = spark.createDataFrame([("a", 0.0, None)], "symbol string, pre double, post double")
    two = spark.createDataFrame([("a", 1.5, 2.5), ("b", None, -1.0)], "symbol string, pre double, post double")
    assert [(r.symbol, r.price, r.source) for r in ingest.session_overrides(none, two, F.lit("pre")).collect()] == [("A", 1.5, 2)]
    assert ingest.session_overrides(two, two, F.lit("regular")).count() == 0


def test_days_and_caches(spark, tmp_path):
    d = spark.createDataFrame([("core", date(2024, 1, i)) for i in (1, 2, 3)], "universe string, d date")
    today = F.lit("2024-01-03").cast("date")
    assert filters.effective_days(d, today, True).count() == 3 and filters.effective_days(d, today, False).count() == 2
    assert {r.d for r in filters.shifted_days(d, F.lit("2024-01-20").cast("date")).collect()} == {date(2024, 1, i) for i in (18, 19, 20)}
    sinks.write_snapshot(d, str(tmp_path / "c"), "2024-01-01 10:00:00")
    now = lambda x: F.lit(x).cast("timestamp")
    assert {r.stale for r in ingest.cached(spark, str(tmp_path / "c"), now("2024-01-01 10:09:00")).collect()} == {False}
    assert {r.stale for r in ingest.cached(spark, str(tmp_path / "c"), now("2024-01-01 10:11:00")).collect()} == {True}
    sinks.append_history(d.limit(1), str(tmp_path / "h"))
    sinks.append_history(d.limit(2), str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 3


def test_writers_and_their_readers(spark, tmp_path):
    rows = spark.createDataFrame([(f, float(i), 1.0 + i, -float(i), 2.0, 0.6) for i, f in enumerate(report.FEATURES)], "feature string, mu_up double, var_up double, mu_dn double, var_dn double, prior_up double").repartition(3)
    sinks.write_model(rows, str(tmp_path / "m"), (0.2, 0.3), "2024-01-01")
    m = ingest.model(spark, str(tmp_path / "m")).first()
    assert m.mu_up == [float(i) for i in range(9)] and m.calib == [0.2, 0.3] and m.prior_up == 0.6
    sinks.write_tuning(spark.createDataFrame([("core", 30, 21, 63)], "universe string, cycle int, fast int, slow int"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).first()["stab_tune"]["slow"] == 63
    sinks.write_favorites(spark.createDataFrame([("b", 2), (" a ", 1), ("b", 5), ("not one", 0)], "symbol string, position int"), str(tmp_path / "f"))
    assert [r.symbol for r in spark.read.json(str(tmp_path / "f")).orderBy("position").collect()] == ["A", "B"]
    (tmp_path / "r.json").write_text('{"prob": {"p_up": 0.62, "p_up_raw": 0.58}, "drivers": [["RV20", 0.5], ["ADR", -0.2]], "features": {"ADR": 1.1}, "markdown": "x"}')
    r = ingest.report(spark, str(tmp_path / "r.json")).first()
    assert (r.p_up, r.p_raw) == (0.62, 0.58) and [(d.feature, d.llr) for d in r.drivers] == [("RV20", 0.5), ("ADR", -0.2)] and r.features == {"ADR": 1.1}
    lines = sinks.report_summary(spark.createDataFrame([("core", 0.625)], "universe string, p_up double"), spark.createDataFrame([("core", 2, "B", -0.1), ("core", 1, "A", 0.25)], "universe string, rank int, feature string, llr double"))
    assert [x.line for x in lines.orderBy("number").collect()] == ["Upward probability: 62.50%", "Top drivers: A:+0.250, B:-0.100"]
    sinks.write_lines(sinks.report_lines(a=spark.createDataFrame([(2, "y"), (1, "x")], "number int, line string")), str(tmp_path / "l"))
    assert [x.value for x in spark.read.text(str(tmp_path / "l")).collect()] == ["[a]", "x", "y"]


def test_lines_of_transitions(spark):
    d = spark.createDataFrame([("core", 0, date(2024, 1, 2), 1, True, 0.5, 0.4, 0.3, 0.9, 0.8, 0.02)], "universe string, idx int, d date, state int, fragile boolean, score double, pair_corr double, safe_negative double, guard double, mm double, combo double")
    line = lambda mode: d.select(sections.transition_text(d, mode)).first()[0]
    assert line("classic") == "- 2024-01-02 Risk-On (fragile) (Score=0.5000, Corr=0.4000, Safe-NEG=0.3000)"
    assert line("enhanced").endswith("Guard=0.9000, Absorption=0.8000, Combo=+2.00%)") and "J_norm=N/A" in line("flow") and "wTA=N/A" in line("newgate")


def test_captures_and_timing(spark):
    rows = [("core", i, date(2024, 1, 1) + timedelta(i), s, e, r) for i, (s, e, r) in enumerate([(0, 0, 0.0), (1, 0, 0.1), (1, 1, -0.1), (-1, 1, 0.2), (-1, -1, 0.1), (0, -1, -0.1)])]
    t = spark.createDataFrame(rows, "universe string, idx int, d date, state int, executed int, ret double")
    c = backtest.captures(t).first()
    assert (c.share_on, c.share_off, c.share_neutral) == pytest.approx((2 / 6, 1 / 6, 2 / 6)) and (c.on_capture, c.neutral_miss, c.off_miss) == (1.0, 0.5, 0.0)
    h = backtest.timing_hits(t, 2).first()
    assert (h.on_hits, h.off_hits, h.n_on, h.n_off) == (1.0, 1.0, 1, 1)  # 0.9 * 1.2 > 1; 1.1 * 0.9 < 1


def test_snapshot_of_a_report(spark):
    w = spark.createDataFrame([("core", "CASH", 0.5), ("core", "A", 0.2), ("core", "B", 0.3), ("core", "C", 0.0005)], "universe string, symbol string, weight double")
    assert [(r.symbol, r["rank"]) for r in snapshot.allocation(w).orderBy("rank").collect()] == [("B", 1), ("A", 2)]
    p = spark.createDataFrame([("a", "QQQ", 1.0), ("a", "IWM", 1.0), ("b", "QQQ", 1.0)], "universe string, symbol string, close double")
    assert {r.universe for r in snapshot.complete_universes(p, ("QQQ", "IWM")).collect()} == {"a"}


def test_required_symbols_and_vendor_tables(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"assets": [{"symbol": "A", "dates": ["2024-01-01"], "prices": [1.0], "opens": [1.0]}]}')
    assert ingest.history(spark, str(tmp_path / "h.json"), required=("A",)).count() == 1
    with pytest.raises(ValueError, match="no rows of B"):
        ingest.history(spark, str(tmp_path / "h.json"), required=("A", "B"))
    holders = spark.createDataFrame([('{"assetSymbol": "x"}', 1), ('{"ticker": "Y"}', 2), ('{"other": "z"}', 3)], "value string, n int")
    assert {(r.symbol, r.basket, r.position) for r in ingest.holdings(ingest.holder_rows(holders)).collect()} == {("X", 0, 1), ("Y", 0, 2)}
    c = report.curve_rows(spark.createDataFrame([("2024-01-01", "5", "4", "3", "2"), ("2024-01-02", "5", None, "3", "2")], "DATE string, `3M` string, YEAR2 string, `10Y` string, Y30 string")).collect()
    assert [(r.d, r.month3, r.year2, r.year10, r.year30) for r in c] == [("2024-01-01", 5.0, 4.0, 3.0, 2.0)]


def test_stream_falls_back_and_forgets(spark, tmp_path):
    old = spark.createDataFrame([("A", 1.0)], "symbol string, price double")
    path = str(tmp_path / "snap")
    assert stream.last_snapshot(spark, path, old).first().price == 1.0
    save = stream.snapshots(path)
    for n in (0, 1, 10):
        save(old.withColumn("price", F.lit(float(n))), n)
    (tmp_path / "snap" / "batch=10" / "_SUCCESS").unlink()
    assert stream.last_snapshot(spark, path, old).first().price == 1.0
    over = spark.createDataFrame([("B", 9.0)], "symbol string, price double")
    assert {(r.symbol, r.price) for r in stream.with_overrides(old.unionByName(old.withColumn("symbol", F.lit("B"))), over).collect()} == {("A", 1.0), ("B", 9.0)}
    ev = spark.createDataFrame([(1, datetime(2024, 1, 1), 70.0), (2, datetime(2024, 1, 2), 70.0)], "user_id long, ts timestamp, value double")
    later = spark.createDataFrame([(2, datetime(2024, 3, 1), 30.0)], ev.schema)
    last = spark.createDataFrame([(1, datetime(2024, 3, 2), 30.0)], ev.schema)
    for rows in (ev, later, last):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        s = stream.latch_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), 60, 10, forget_after="30 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        s.processAllAvailable()
        s.stop()
    got = {(r.user_id, r.ts, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (1, datetime(2024, 3, 2), 0) in got and (1, datetime(2024, 1, 1), 1) in got


def test_names_are_defined_once():
    """No module defines a function or class twice: Python would silently keep the last."""
    import ast
    from collections import Counter
    from pathlib import Path

    for f in Path(__file__).parents[1].glob("tidemark/**/*.py"):
        tree = ast.parse(f.read_text())
        for body in [tree.body, *(n.body for n in ast.walk(tree) if isinstance(n, ast.ClassDef))]:
            names = Counter(n.name for n in body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
            assert not [k for k, v in names.items() if v > 1], f


@pytest.mark.parametrize("variant", ["classic", "exp", "stab"])
def test_flow_thresholds_of_scores(spark, variant):
    d = spark.createDataFrame([(i / 100, i / 100) for i in range(100)], "j double, score double")
    on, off = flow.score_thresholds(d, Flow(variant))
    assert (on, off) == ((0.60, 0.40) if variant == "classic" else (pytest.approx(0.7425), pytest.approx(0.2475)))
