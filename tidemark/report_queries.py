"""Queries of searches, runners, snapshots and the text report; registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import EXECUTIONS, NEWGATE, SIGNALS, STAB_ASYMMETRIC, Execution, Flow, Stab
from tidemark.functions import numeric as N
from tidemark.functions import text as TX
from tidemark.operators import align, filters, folds, islands
from tidemark.operators import rolling as W
from tidemark.plans import backtest as B
from tidemark.plans import engines, flow, flux5, frame, narrative, newgate, report, search, sections, snapshot
from tidemark.plans import records as R
from tidemark.queries import (
    _CLASSIC, _CLOSE, _EMA, _FIT, _FITTED_TR, _LATCH, _LLR, _NB, _OPEN_CLOSE, _QQQ, _SEG, _TN, _TO_AL, _TO_CO, _TO_Q, _TO_REC, _TO_RET, _LASTQ, _panel_sql, _log, _logs, _r, _rounds, _test_sql, _with,
    U, bars, base, fitted_rows, fitted_traded, labelled, latched, query, settled_bars, table,
)
from tidemark.sources import ingest, shared, sinks

_NO_FUTURE = "CASE WHEN idx >= 5 THEN close / lag(close, 5) OVER (ORDER BY idx) - 1 END"


# ---------------------------------------------------------------- rules of the flow engine
@query("SELECT event_id, CASE WHEN value > 60 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END >= 0 AND coalesce(CASE WHEN user_id % 7 > 0 THEN value / 100 END, 1) >= 0.88 AS fragile FROM events")
def r03_fragile(spark, sf_dir):
    """The flag of weak days, over made states and guards up to 1 and beyond, some unknown."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 60, 1).when(F.col("value") < 20, -1).otherwise(0).alias("state"), F.when(F.col("user_id") % 7 > 0, F.col("value") / 100).alias("guard"))
    return rows.select("event_id", flow.fragile("state", "guard").alias("fragile"))


_GUARD = """sl AS (SELECT rec.idx, e3 - e10 AS s FROM rec JOIN ema USING (idx)),
zl AS (SELECT idx, s, list(s) OVER (ORDER BY idx ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS h FROM sl),
zm AS (SELECT idx, s, h, list_sort(h)[len(h) // 2 + 1] AS m FROM zl),
zz AS (SELECT idx, s, CASE WHEN len(h) >= 5 THEN s / nullif(1.4826 * list_sort(list_transform(h, lambda v: abs(v - m)))[len(h) // 2 + 1], 0) END AS z FROM zm),
fl AS (SELECT idx, coalesce(z >= 1 AND s >= 0.001, false) AS up, coalesce(z <= -1 AND s <= -0.001, false) AS dn FROM zz),
fr AS MATERIALIZED (SELECT idx, up AND coalesce(lag(up) OVER (ORDER BY idx), false) AS lead, dn AND coalesce(lag(dn) OVER (ORDER BY idx), false) AS fall FROM fl),
cd AS (SELECT idx, 0 AS l, 0 AS g, 0 AS h, 0 AS on_lead, 0 AS on_hazard FROM fr WHERE idx = (SELECT min(idx) FROM fr)
 UNION ALL SELECT fr.idx, greatest(CASE WHEN lead THEN greatest(l, 3) ELSE l END - 1, 0), greatest(CASE WHEN fall THEN greatest(g, 2) ELSE g END - 1, 0),
 CASE WHEN CASE WHEN fall THEN greatest(g, 2) ELSE g END > 0 THEN CASE WHEN fall THEN greatest(h, 4) ELSE h END ELSE greatest(h - 1, 0) END,
 CASE WHEN CASE WHEN lead THEN greatest(l, 3) ELSE l END > 0 THEN 1 ELSE 0 END, CASE WHEN CASE WHEN fall THEN greatest(g, 2) ELSE g END = 0 AND h > 0 THEN 1 ELSE 0 END
 FROM cd JOIN fr ON fr.idx = cd.idx + 1),
qq AS (SELECT idx, close / lag(close, 5) OVER (ORDER BY idx) - 1 AS r5 FROM q)"""


@query(_with((*_TO_REC, _EMA, _QQQ, _LATCH, _GUARD), "SELECT cd.idx, la.state, on_lead AS up_lead, on_hazard AS hazard, CASE WHEN la.state > 0 AND on_hazard = 1 THEN 0 WHEN la.state < 0 AND on_lead = 1 AND coalesce(r5, 0) > 0 THEN 1 ELSE la.state END AS guarded FROM cd JOIN la ON la.idx = cd.idx JOIN qq ON qq.idx = cd.idx", True))
def r17_guarded_overrides(spark, sf_dir):
    """The overrides alone, on a latched state, with an overlay so short that leads and hazards occur."""
    w = W.series(U)
    base_rows = latched(spark, sf_dir).select(U, "idx", "state", W.simple_return("close", w, 5).alias("ret5"))
    rows = frame.records(bars(spark, sf_dir)).select(U, "idx", "stability").join(base_rows, [U, "idx"])
    stab = Stab(fast=3, slow=10, z_win=63, z_up=1.0, z_down=1.0, slope_min=0.001, lag_up=2, lag_down=2, lead_on=3, down_grace=2, hazard=4)
    return narrative.guarded(rows, stab).select("idx", "state", "up_lead", "hazard", "guarded")


@query()
def r17_guarded(spark, sf_dir):
    rows = flow.flow(settled_bars(spark, sf_dir), 30, Flow("classic")).withColumn("ret5", F.col("bench5"))
    return narrative.guarded(rows).select("idx", "state", "guarded")


@query()
def r16_plain_flow(spark, sf_dir):
    p, cols = Flow("stab"), shared.settled(flow.columns(settled_bars(spark, sf_dir)), "flow")
    met = flow.with_thresholds(cols, flow.fit(cols, p), p)
    return flow.plain_state(met, *(F.col(c) for c in ("on", "off", "score_on", "score_off"))).select("idx", "score", "j", "state", "fragile")


@query()
def r28_presets(spark, sf_dir):
    """The last state and exposure of every preset."""
    p = settled_bars(spark, sf_dir)
    f = shared.settled(flow.columns(p).select(U, "idx", F.col("mm").alias("flow_mm"), F.col("j").alias("flow_j"), F.col("guard").alias("flow_guard")), "flow")
    before = shared.settled(newgate.stress_inputs(p), "stress")
    out = None
    for name, preset in NEWGATE.items():
        done = newgate.from_inputs(before, preset, f)
        row = done.groupBy(U).agg(F.max_by("position", "idx").alias("position"), F.max_by("state", "idx").alias("state"), F.avg("position").alias("mean_position")).withColumn("preset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- searches and objectives
_STATS = f"""c AS (SELECT *, CASE WHEN state <> lag(state) OVER (ORDER BY idx) THEN 1 WHEN lag(state) OVER (ORDER BY idx) IS NULL THEN NULL ELSE 0 END AS ch FROM bt),
sx AS (SELECT count(*) AS n, ln(arg_max(equity, idx)) AS log_equity, exp(ln(arg_max(equity, idx)) * 252 / count(*)) - 1 AS cagr, min(dd) AS mdd, avg(CASE WHEN executed <> 0 THEN CASE WHEN executed * ret > 0 THEN 1.0 ELSE 0.0 END END) AS hr, avg(CASE WHEN executed > 0 THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END) AS on_hr, sum(ch) AS tr FROM c)"""


@query(_with((*_FITTED_TR, *_test_sql(_CLOSE, 1, 0.33 * 3), _STATS), f"SELECT {_r('3 * cagr + 0.5 * hr - 1.2 * greatest(0, -mdd - 0.45) - 0.01 * tr * 252 / n', 'blended')}, {_r('cagr + 0.3 * (on_hr - 0.5) + 0.4 * mdd - 0.2 * tr / n', 'exp')}, {_r('ln(1 + greatest(exp(greatest(log_equity, ln(1e-6))) - 1, -0.8)) + 0.4 * (on_hr - 0.5) + 0.4 * mdd - 0.15 * tr / n', 'segments')} FROM sx"))
def a31_objectives(spark, sf_dir):
    """The three objectives of one backtest; the segment form over its single segment."""
    s = B.statistics(B.backtest(fitted_traded(spark, sf_dir), Execution("close_close"))).withColumn("candidate", F.lit(0))
    a = search.objective_exp(search.objective_blended(s).withColumnRenamed("objective", "blended")).withColumnRenamed("objective", "exp")
    return a.join(search.objective_segments(s).withColumnRenamed("objective", "segments"), "candidate").select("blended", "exp", "segments")


def _exp_segments(spark, sf_dir):
    parts = search.in_parts(settled_bars(spark, sf_dir), {"s1": ("1992-01-01", "1993-12-31"), "s2": ("1994-01-01", "1995-12-31"), "s3": ("1996-01-01", "1997-12-31"), "s4": ("1998-01-01", "1999-12-31")})
    return shared.settled(flow.columns(parts, 30), "flow")


def _stab_splits(spark, sf_dir):
    parts = search.in_parts(settled_bars(spark, sf_dir), {"s1": ("1992-01-01", "1994-06-30"), "s2": ("1994-07-01", "1996-12-31"), "s3": ("1997-01-01", "1999-12-31")})
    return shared.settled(flow.columns(parts, 30), "flow")


@query()
def b13_exp_random(spark, sf_dir):
    """The published number of drawn candidates, 120, of the exp variant over four segments, by the segment objective."""
    stats = search.search_flow(_exp_segments(spark, sf_dir), search.drawn_exp(120), Flow("exp"), Execution("close_close", neutral_weight=1.0, neutral_leverage=1.0))
    return search.objective_segments(stats)


@query()
def b14_stab_random(spark, sf_dir):
    """The published number of drawn overlays, 200, over three splits, by the mean blended objective."""
    stats = search.objective_blended(search.search_flow(_stab_splits(spark, sf_dir), search.drawn_stab(200, 42), Flow("stab"), EXECUTIONS["compare_runner"]))
    return stats.groupBy("candidate").agg(F.avg("objective").alias("objective"), F.min("max_drawdown").alias("max_drawdown"))


@query()
def b14_stab_budgeted(spark, sf_dir):
    """The same draws under a count of 200: after each split the better half goes on."""
    cols = _stab_splits(spark, sf_dir)
    evaluate = lambda block, part: search.search_flow(cols.filter(search.part_of() == part), block, Flow("stab"), EXECUTIONS["compare_runner"])
    mean = lambda stats: search.objective_blended(stats).groupBy("candidate").agg(F.avg("objective").alias("objective"))
    return search.budgeted(spark, evaluate, mean, search.drawn_stab(200, 42), ["s1", "s2", "s3"], count=200)


@query()
def b10_stab_profiles(spark, sf_dir):
    """The overlay and a tuned one, traded from open to open."""
    p = settled_bars(spark, sf_dir)
    cols = shared.settled(flow.columns(p), "flow")
    out = None
    for name, stab in (("current", Stab()), ("tuned", STAB_ASYMMETRIC)):
        q = Flow("stab", stab=stab)
        done = flow.decided(cols, q)
        row = B.statistics(B.backtest(done.withColumnsRenamed({"o_QQQ": "open", "c_QQQ": "close"}), EXECUTIONS["compare_runner"])).select("log_equity", "cagr", "max_drawdown", "hit_rate").withColumn("profile", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def b09_classic_flux5(spark, sf_dir):
    """ClassicFlux5 traded from open to open."""
    done = flux5.flux5(flux5.inputs(settled_bars(spark, sf_dir))).select(U, "idx", "d", "state", F.col("o_QQQ").alias("open"), F.col("c_QQQ").alias("close"))
    return B.statistics(B.backtest(done, EXECUTIONS["compare_runner"])).select("n", "log_equity", "log_bench", "cagr", "max_drawdown", "hit_rate")


@query()
def b02_five_engines(spark, sf_dir):
    """Classic, Enhanced and the three flow variants, traded from open to open."""
    cols = shared.settled(flow.columns(settled_bars(spark, sf_dir)), "flow")
    states = {"classic": engines.classic(cols), "enhanced": engines.enhanced(cols)} | {f"flow_{v}": flow.decided(cols, Flow(v)) for v in ("classic", "exp", "stab")}
    rows = None
    for name, s in states.items():
        one = s.select(U, "idx", "d", "state", F.col("o_QQQ").alias("open"), F.col("c_QQQ").alias("close"), F.lit(name).alias("engine"))
        rows = one if rows is None else rows.unionByName(one)
    return B.statistics(B.backtest(rows, EXECUTIONS["compare_runner"], ("engine",)), ("engine",)).select("engine", "log_equity", "log_bench", "cagr", "max_drawdown", "hit_rate")


@query("WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS universe, CAST(o_orderkey % 180 + 2 AS BIGINT) AS cycle FROM orders), w1 AS (SELECT *, least(greatest(CAST(floor(0.7::DOUBLE * cycle + 0.5) AS INT), 14), 42) AS fast FROM c), w2 AS (SELECT *, least(greatest(CAST(floor(2.1::DOUBLE * cycle + 0.5) AS INT), greatest(2 * fast, 40)), 126) AS slow FROM w1) SELECT universe AS name, cycle, fast, slow, CAST(least(greatest(2 * slow, 63), 252) AS INT) AS z_win, CAST(least(greatest(ceil(0.10::DOUBLE * cycle), 2), 6) AS INT) AS lag_up, CAST(least(greatest(ceil(0.13::DOUBLE * cycle), 3), 8) AS INT) AS lag_down, CAST(least(greatest(ceil(0.17::DOUBLE * cycle), 3), 8) AS INT) AS lead_on, CAST(least(greatest(ceil(0.17::DOUBLE * cycle), 3), 8) AS INT) AS down_grace, CAST(least(greatest(ceil(0.27::DOUBLE * cycle), 4), 12) AS INT) AS hazard FROM w2")
def b15_windows(spark, sf_dir):
    """Windows and lags of the overlay for cycles of all lengths."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias(U), (F.col("o_orderkey") % 180 + 2).alias("cycle"))
    return search.cycle_windows(c).withColumnRenamed(U, "name")


@query()
def b15_parameters(spark, sf_dir):
    """The whole overlay from the cycle and the slope of the stability."""
    rec = shared.settled(R.smoothed(frame.records(bars(spark, sf_dir)).select(U, "idx", "d", "stability")), "records")
    return search.stability_parameters(rec, folds.cycle(folds.pivots(rec, "smoothed"), low=30, high=180).select(U, "cycle"))


# ---------------------------------------------------------------- runners and their statistics
_BEAR = "(coalesce(m >= 0.9, false) AND coalesce(b10 <= 0, true))"
_RUN = """rs AS (SELECT tr.*, rec.stability * 6 AS m, CASE WHEN tr.idx >= 10 THEN tr.close / q10 - 1 END AS b10, CASE WHEN tr.idx % 11 <> 0 THEN rec.stability * 5 - 0.2 END AS ratio FROM tr JOIN rec ON rec.idx = tr.idx JOIN (SELECT idx, lag(close, 10) OVER (ORDER BY idx) AS q10 FROM q) AS t ON t.idx = tr.idx),
rl AS (SELECT *, coalesce(lag(state) OVER (ORDER BY idx), 0) AS executed, coalesce(close / lag(close) OVER (ORDER BY idx) - 1, 0) AS ret, CASE WHEN ratio IS NULL THEN 1.0 ELSE 1.0 + 2.0 * least(greatest((ratio - 0.5) / 0.7, 0), 1) END AS lv FROM rs),"""
_RUN_EQ = """re AS (SELECT *, CASE WHEN executed > 0 THEN greatest(-0.99, leverage * (close / open - 1)) WHEN executed < 0 THEN 0 ELSE ret END AS ret_strategy FROM rx)
SELECT idx, executed, round(leverage, 6) + 0 AS leverage, round(ret_strategy, 6) + 0 AS ret_strategy, round(sum(ln(1 + ret_strategy)) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) + 0 AS log_equity FROM re"""


def _run_rows(spark, sf_dir):
    w = W.series(U)
    d = fitted_rows(spark, sf_dir)
    ten = base(spark, sf_dir).select(U, "idx", W.simple_return("close", w, 10).alias("bench10"))
    return d.select(U, "idx", "d", "state", F.col("o_QQQ").alias("open"), F.col("c_QQQ").alias("close"), (F.col("stability") * 6).alias("mm"), F.when(F.col("idx") % 11 != 0, F.col("stability") * 5 - 0.2).alias("ratio")).join(ten, [U, "idx"])


@query(_with(_FITTED_TR, "").rstrip() + ", " + _RUN + f" rx AS (SELECT *, CASE WHEN {_BEAR} THEN 1.0 ELSE 3.0 END AS leverage FROM rl), " + _RUN_EQ)
def b03_ffl_runner(spark, sf_dir):
    """On days from their open, once levered in a falling, highly correlated market; the coupling stands for the absorption."""
    t = B.runner_backtest(B.with_runner_leverage(_run_rows(spark, sf_dir)))
    return t.select("idx", "executed", "leverage", "ret_strategy", F.ln("equity").alias("log_equity"))


@query(_with(_FITTED_TR, "").rstrip() + ", " + _RUN + f" rx AS (SELECT *, CASE WHEN {_BEAR} THEN greatest(1.0, least(lv, 1.25)) ELSE lv END AS leverage FROM rl), " + _RUN_EQ)
def b03_dynamic_leverage(spark, sf_dir):
    t = B.runner_backtest(B.with_runner_leverage(_run_rows(spark, sf_dir), dynamic=True))
    return t.select("idx", "executed", "leverage", "ret_strategy", F.ln("equity").alias("log_equity"))


_ASSET = "aa AS (SELECT tr.*, exp(sum(ln(1 + least(greatest(0.5 * coalesce(q.sr, 0), -0.99), 5))) OVER (ORDER BY tr.idx ROWS UNBOUNDED PRECEDING)) AS asset_close FROM tr JOIN q ON q.idx = tr.idx)"


def _asset_sql(price: str, delay: int, neutral: float, rows: str = "aa", key: str = "") -> str:
    p, a = ("coalesce(open, close)", "asset_close") if price == "open" else ("close", "asset_close")
    by = f"PARTITION BY {key} " if key else ""
    return f"""ae AS (SELECT *, coalesce(lag(state, {delay}) OVER w, 0) AS executed, coalesce({p} / lag({p}) OVER w - 1, 0) AS ret, coalesce({a} / lag({a}) OVER w - 1, 0) AS ra FROM {rows} WINDOW w AS ({by}ORDER BY idx)),
af AS (SELECT *, CASE WHEN executed > 0 THEN ra WHEN executed < 0 THEN 0 ELSE {neutral} * ra END AS rs FROM ae),
ag AS (SELECT *, sum(ln(1 + rs)) OVER w AS le, sum(ln(1 + ret)) OVER w AS lb, sum(ln(1 + ra)) OVER w AS la2 FROM af WINDOW w AS ({by}ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


def _asset_rows(spark, sf_dir):
    """Fitted states with another asset: half of the base's returns, compounded (made bars are too wild for more)."""
    w = W.series(U)
    rows = fitted_rows(spark, sf_dir)
    made = F.exp(F.sum(F.ln(1 + N.clamp_levered(0.5 * F.coalesce("s_QQQ", F.lit(0.0))))).over(W.so_far(w)))
    return rows.select(U, "idx", "d", "state", F.col("o_QQQ").alias("open"), F.col("c_QQQ").alias("close"), made.alias("asset_close")).withColumn("asset_open", F.col("asset_close"))


@query(_with((*_FITTED_TR, _ASSET, _asset_sql("close", 2, 0.33)), f"SELECT idx, executed, {_r('le', 'log_equity')}, {_r('lb', 'log_bench')}, {_r('la2', 'log_asset')}, {_r('ln(coalesce(lead(close) OVER (ORDER BY idx), close))', 'price_bench')} FROM ag"))
def b05_asset_backtest(spark, sf_dir):
    """States traded in the levered asset at the close, two rows late."""
    t = B.asset_backtest(_asset_rows(spark, sf_dir), "close", 2)
    return t.select("idx", "executed", F.ln("equity").alias("log_equity"), F.ln("equity_bench").alias("log_bench"), F.ln("equity_asset").alias("log_asset"), F.ln("price_bench").alias("price_bench"))


_RANGE = "ab AS (SELECT * REPLACE (row_number() OVER (ORDER BY idx) - 1 AS idx) FROM aa WHERE d BETWEEN DATE '1994-01-01' AND DATE '1996-06-30')"


@query(_with((*_FITTED_TR, _ASSET, _RANGE, _asset_sql("open", 1, 0.33, "ab")), f"SELECT CAST(idx AS INT) AS idx, executed, {_r('le', 'log_equity')}, {_r('lb', 'log_bench')} FROM ag"))
def b06_range(spark, sf_dir):
    """The next-open backtest within a range of days."""
    day = lambda x: F.lit(x).cast("date")
    t, _ = B.tomorrow_open(_asset_rows(spark, sf_dir), day("1994-01-01"), day("1996-06-30"))
    return t.select("idx", "executed", F.ln("equity").alias("log_equity"), F.ln("equity_bench").alias("log_bench"))


@query(_with((*_FITTED_TR, "ab AS (SELECT * FROM tr WHERE d >= DATE '1994-01-01')"), "SELECT 'T+1_open' AS execution_basis, 'open' AS price_mode, 1 AS delay_days, DATE '1994-01-01' AS start_d, max(d) AS end_d, 'America/New_York' AS tz FROM ab"))
def b06_manifest(spark, sf_dir):
    return B.tomorrow_open(_asset_rows(spark, sf_dir), F.lit("1994-01-01").cast("date"))[1]


_THREE = """te AS (SELECT aa.* EXCLUDE (state), e.engine, CASE e.engine WHEN 'fitted' THEN aa.state WHEN 'latched' THEN la.state ELSE -la.state END AS state FROM aa JOIN la ON la.idx = aa.idx, (VALUES ('fitted'), ('latched'), ('contrary')) AS e(engine)),
tm AS (SELECT te.*, m.mode, m.delay FROM te, (VALUES ('close0', 0), ('close1', 1), ('open1', 1)) AS m(mode, delay))"""
_MODES = """me AS (SELECT *, CASE WHEN delay = 0 THEN state ELSE coalesce(lag(state) OVER w, 0) END AS executed, CASE WHEN mode = 'open1' THEN coalesce(open, close) ELSE close END AS p FROM tm WINDOW w AS (PARTITION BY engine, mode ORDER BY idx)),
mf AS (SELECT *, coalesce(asset_close / lag(asset_close) OVER w - 1, 0) AS ra, coalesce(p / lag(p) OVER w - 1, 0) AS ret FROM me WINDOW w AS (PARTITION BY engine, mode ORDER BY idx)),
mg AS (SELECT engine, mode, idx, executed, sum(ln(1 + CASE WHEN executed > 0 THEN ra WHEN executed < 0 THEN 0 ELSE 0.4 * ra END)) OVER w AS le, sum(ln(1 + ret)) OVER w AS lb FROM mf WINDOW w AS (PARTITION BY engine, mode ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


@query(_with((*_FITTED_TR, _ASSET, _LATCH, _THREE, _MODES), f"SELECT engine, mode, idx, executed, {_r('le', 'log_equity')}, {_r('lb', 'log_bench')} FROM mg"))
def b08_web(spark, sf_dir):
    """Three engines in three modes: at the close of the day, at the next close, at the next open; neutral holds 0.40."""
    rows = _asset_rows(spark, sf_dir).withColumnRenamed("state", "fitted").join(latched(spark, sf_dir).select(U, "idx", F.col("state").alias("latched")), [U, "idx"])
    named = F.array(*(F.struct(F.lit(n).alias("engine"), s.alias("state")) for n, s in (("fitted", F.col("fitted")), ("latched", F.col("latched")), ("contrary", -F.col("latched")))))
    return B.web_modes(rows.select("*", F.inline(named)), ("engine",)).select("engine", "mode", "idx", "executed", F.ln("equity").alias("log_equity"), F.ln("equity_bench").alias("log_bench"))


_TIMED = "tx AS (SELECT idx, state, lag(state) OVER (ORDER BY idx) AS b, coalesce(exp(sum(ln(1 + ret)) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)) - 1, 0) AS f FROM bt)"
_HITS = "coalesce(avg(CASE WHEN state = 1 THEN CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END END), 0) AS on_hits, coalesce(avg(CASE WHEN state = -1 THEN CASE WHEN f < 0 THEN 1.0 ELSE 0.0 END END), 0) AS off_hits, count(CASE WHEN state = 1 THEN 1 END) AS n_on, count(CASE WHEN state = -1 THEN 1 END) AS n_off FROM tx WHERE b IS NOT NULL AND state <> b AND state <> 0"


@query(_with((*_FITTED_TR, *_test_sql(_CLOSE, 1, 0.33 * 3), _TIMED.format(k=5), "ty AS (" + _TIMED.format(k=10)[7:]), "SELECT 5 AS k, " + _HITS.replace("coalesce(avg", "round(coalesce(avg").replace(", 0) AS", ", 0), 6) + 0 AS") + " UNION ALL SELECT 10, " + _HITS.replace("FROM tx", "FROM ty").replace("coalesce(avg", "round(coalesce(avg").replace(", 0) AS", ", 0), 6) + 0 AS")))
def a18_timing_hits(spark, sf_dir):
    t = shared.settled(B.backtest(fitted_traded(spark, sf_dir), Execution("close_close")), "tested")
    return B.timing_hits(t, 5).withColumn("k", F.lit(5)).unionByName(B.timing_hits(t, 10).withColumn("k", F.lit(10)))


@query(_with((*_FITTED_TR, *_test_sql(_CLOSE, 1, 0.33 * 3), "nx AS (SELECT *, lead(ret) OVER (ORDER BY idx) AS nr, lead(idx) OVER (ORDER BY idx) IS NOT NULL AS h FROM bt)"), "SELECT " + ", ".join(_r(f"count(CASE WHEN h AND sign(executed) = {s} THEN 1 END) / count(*)", f"share_{k}") for k, s in (("on", 1), ("off", -1), ("neutral", 0))) + ", " + ", ".join(_r(f"coalesce(avg(CASE WHEN h AND sign(executed) = {s} THEN CAST(nr > 0 AS INT) END), 0)", k) for k, s in (("on_capture", 1), ("neutral_miss", 0), ("off_miss", -1))) + " FROM nx"))
def a19_captures(spark, sf_dir):
    return B.captures(B.backtest(fitted_traded(spark, sf_dir), Execution("close_close")))


@query(_with((*_FITTED_TR, *_test_sql(_OPEN_CLOSE, 1, 0.33 * 3), "y AS (SELECT CAST(year(d) AS INT) AS year, arg_max(equity, d) AS last FROM bt GROUP BY 1)"), f"SELECT year, {_r('last / coalesce(lag(last) OVER (ORDER BY year), 1) - 1', 'ret')} FROM y"))
def a20_yearly_equity(spark, sf_dir):
    return B.yearly(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["app"]))


@query(_with((*_FITTED_TR, *_test_sql(_OPEN_CLOSE, 1, 0.33 * 3), "lv AS (SELECT idx, sum(ln(1 + greatest(-0.99, 3 * ret))) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS l FROM bt)"), f"SELECT idx, {_r('l - first_value(l) OVER (ORDER BY idx)', 'log_levered')} FROM lv"))
def b01_levered_line(spark, sf_dir):
    return B.with_levered(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["app"])).select("idx", F.ln("equity_levered").alias("log_levered"))


# ---------------------------------------------------------------- snapshots
_FACTS = "fc AS (SELECT CAST(s_suppkey AS VARCHAR) AS universe, DATE '1998-07-01' - CAST(s_suppkey % 2 AS INT) AS fusion_last, DATE '1998-07-01' AS today, s_suppkey % 3 = 0 AS stub, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 5 > 1 END AS intraday, s_suppkey % 7 > 0 AS quotes, CAST(s_suppkey % 4 AS INT) AS last FROM supplier)"


@query(_with((_FACTS, "b AS (SELECT *, last > 0 AND fusion_last = today AND (stub OR NOT coalesce(intraday, false) OR NOT quotes) AS back FROM fc)"), "SELECT universe AS name, last AS idx_last, last - CAST(back AS INT) AS idx, back AS used_fallback, CASE WHEN back THEN concat_ws(', ', CASE WHEN stub THEN 'QQQ stubbed' END, CASE WHEN NOT coalesce(intraday, false) THEN 'intraday base not patched' END, CASE WHEN NOT quotes THEN 'quotes missing' END) ELSE '' END AS reason FROM b"))
def p13_effective_row(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    days = s.select(k.cast("string").alias(U), F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("idx"))
    day = F.lit("1998-07-01").cast("date")
    facts = s.select(k.cast("string").alias(U), F.date_sub(day, (k % 2).cast("int")).alias("fusion_last"), day.alias("today"), F.when(k % 3 == 0, F.array(F.lit("qqq"))).otherwise(F.array(F.lit("SPY"))).alias("stubbed"), F.when(k % 5 > 0, k % 5 > 1).alias("intraday"), (k % 7 > 0).alias("quotes"))
    return snapshot.effective_row(days, facts, fallback=True).withColumn("name", F.col(U)).drop(U)


@query(_with((*_FITTED_TR, "l AS (SELECT max(idx) AS i FROM tr)", "x AS (SELECT *, coalesce(lag(state) OVER (ORDER BY idx), 0) AS executed FROM tr)"), f"SELECT d, state, executed, {_r('CAST(state AS DOUBLE) / 2', 'score')}, {_r('(SELECT ln(arg_max(close, d)) FROM panel WHERE symbol = $$IWM$$)', 'price')}, {_r('(SELECT ln(arg_max(close, d)) FROM panel WHERE symbol = $$QQQ$$)', 'price_bench')}, {_r('(SELECT ln(arg_max(open, d)) FROM panel WHERE symbol = $$QQQ$$)', 'open_bench')}, d = DATE '1998-12-31' AS last_is_today FROM x, l WHERE idx = i"))
def q07_normalized(spark, sf_dir):
    """The first candidate symbol is unknown, so the second one's price shows."""
    s = fitted_states_with_weights(spark, sf_dir)
    out = snapshot.normalized(s, bars(spark, sf_dir), ("TQQQ", "IWM"), F.lit("1998-12-31").cast("date"))
    return out.select("d", "state", "executed", "score", *_log("price", "price_bench", "open_bench"), "last_is_today")


def fitted_states_with_weights(spark, sf_dir):
    s = fitted_traded(spark, sf_dir)
    known = lambda n: F.when(F.col("idx") % n != 0, F.col("idx") / 10000)
    return s.withColumns({"score": F.col("state") / 2, "w_trend": known(3), "w_flow": known(7)})


@query(_with(_FITTED_TR, f"SELECT {_r('max(CASE WHEN idx % 3 <> 0 THEN idx END) / 10000', 'w_trend')}, {_r('max(CASE WHEN idx % 7 <> 0 THEN idx END) / 10000', 'w_flow')} FROM tr"))
def q08_last_weights(spark, sf_dir):
    return snapshot.last_weights(fitted_states_with_weights(spark, sf_dir)).select("w_trend", "w_flow")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN DATE '1998-01-01' END, CASE WHEN o_orderkey % 3 = 0 THEN DATE '1998-01-02' END, CASE WHEN o_orderkey % 5 = 0 THEN DATE '1998-01-03' END, CAST(o_orderdate AS DATE)) AS basis_d FROM orders")
def q08_basis(spark, sf_dir):
    k, day = F.col("o_orderkey"), lambda x: F.lit(x).cast("date")
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 2 == 0, day("1998-01-01")).alias("fusion_last"), F.when(k % 3 == 0, day("1998-01-02")).alias("inter_last"), F.when(k % 5 == 0, day("1998-01-03")).alias("today"), F.to_date("o_orderdate").alias("d"))
    return snapshot.basis(rows).select("o_orderkey", "basis_d")


@query("WITH n AS (SELECT c_custkey AS k, CAST(c_custkey % 9 AS INT) AS last FROM customer), p AS (SELECT k, last, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 99 ELSE k % 5 END AS day FROM n) SELECT CAST(k AS VARCHAR) AS name, CAST(CASE WHEN day <= last THEN day ELSE greatest(last - 1, 0) END AS INT) AS idx FROM p")
def q11_previous_row(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    at = lambda n: F.date_add(F.lit("1998-01-01").cast("date"), n.cast("int"))
    days = c.select(k.cast("string").alias(U), F.explode(F.sequence(F.lit(0), (k % 9).cast("int"))).alias("idx")).withColumn("d", at(F.col("idx")))
    before = c.select(k.cast("string").alias(U), F.when(k % 4 == 0, None).when(k % 4 == 1, at(F.lit(99))).otherwise(at(k % 5)).alias("prev_close"))
    return snapshot.previous_row(days, before).withColumn("name", F.col(U)).drop(U)


@query(_with((*_TO_REC, _CLASSIC, _QQQ, _LATCH), f"SELECT rec.idx, {_r('coalesce(CASE WHEN rec.idx % 2 = 0 THEN r END, cl.score)', 'score')}, {_r('rec.safe_negative', 'safe_negative')}, {_r('coalesce(q.r, cl.score)', 'r')} FROM rec JOIN cl USING (idx) JOIN q USING (idx)"))
def p11_first_finite(spark, sf_dir):
    """Values side by side: the first engine knows a score on even rows only, the second one has the rest."""
    rec = engines.classic(frame.records(bars(spark, sf_dir)))
    first = rec.select(U, "idx", F.when(F.col("idx") % 2 == 0, F.col("r_QQQ")).alias("score"), F.col("r_QQQ").alias("r"))
    return snapshot.first_finite({"a": first, "b": rec.select(U, "idx", "score", "safe_negative", F.col("score").alias("r"))}, ("score", "safe_negative", "r")).select("idx", "score", "safe_negative", "r")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'full' WHEN vec_id % 3 = 1 THEN 'matrix' END AS chosen FROM embeddings")
def p19_matrix(spark, sf_dir):
    """The full matrix has the right size in a third of the rows, the small one in another, none in the last."""
    k = F.col("vec_id") % 3
    two, three = F.array(F.lit("full"), F.lit("full")), F.array(F.lit("x"), F.lit("x"), F.lit("x"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(k == 0, two).otherwise(three).alias("full"), F.when(k == 1, F.array(F.lit("matrix"), F.lit("matrix"))).otherwise(three).alias("matrix"))
    return snapshot.matrix_for(rows, 2).select("vec_id", F.get("chosen", F.lit(0)).alias("chosen"))


@query(_with(_TO_CO, f"SELECT idx, {_r('corr', 'value')} FROM co WHERE s1 = 'SPY' AND s2 = 'TLT'"))
def q02_matrix_value(spark, sf_dir):
    return snapshot.matrix_value(R.correlations(bars(spark, sf_dir)), "TLT", "SPY").select("idx", "value")


@query("WITH n AS (SELECT l_returnflag AS universe, CASE p_type WHEN 'STANDARD' THEN 'QQQ' WHEN 'LARGE' THEN 'IWM' WHEN 'MEDIUM' THEN 'SPY' WHEN 'SMALL' THEN 'TLT' WHEN 'ECONOMY' THEN 'GLD' WHEN 'PROMO' THEN 'BTC-USD' END AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT DISTINCT * FROM n WHERE NOT (universe = 'A' AND symbol = 'GLD')) SELECT universe AS name, symbol FROM m WHERE universe IN (SELECT universe FROM m GROUP BY 1 HAVING count(DISTINCT symbol) = 6)")
def q03_complete(spark, sf_dir):
    """One universe lacks a symbol and goes whole."""
    from tidemark.sources import panel

    p = panel.from_line_items(spark, sf_dir, "week", "l_returnflag").filter(~((F.col(U) == "A") & (F.col("symbol") == "GLD")))
    return snapshot.complete_universes(p).select(F.col(U).alias("name"), "symbol").distinct()


@query("SELECT CAST(o_custkey AS VARCHAR) AS name, CAST(o_orderkey AS VARCHAR) AS symbol, round(o_totalprice / 123456789, 6) + 0 AS weight, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS INT) AS rank FROM orders WHERE o_totalprice / 123456789 > 0.001 AND o_orderstatus <> 'P'")
def l03_allocation(spark, sf_dir):
    """What is invested, cash and small weights aside, the heaviest first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias(U), F.when(F.col("o_orderstatus") == "P", "CASH").otherwise(F.col("o_orderkey").cast("string")).alias("symbol"), (F.col("o_totalprice") / 123456789).alias("weight"))
    return snapshot.allocation(rows).select(F.col(U).alias("name"), "symbol", "weight", "rank")


@query(_with((_panel_sql(),), f"SELECT max(d) AS d, {_r('ln(arg_max(close, d) FILTER (WHERE symbol = $$QQQ$$))', 'price')} FROM panel"))
def m10_bench_snapshot(spark, sf_dir):
    p = bars(spark, sf_dir)
    return snapshot.bench_snapshot(p, p).select("d", *_log("price"))


# ---------------------------------------------------------------- report
@query("SELECT l_orderkey, l_linenumber, list_aggregate(list_filter([CASE WHEN l_quantity / 50 >= 0.6 AND l_discount * 5 > 0.35 THEN 'upside with high short-term volatility' END, CASE WHEN l_quantity / 50 <= 0.4 AND l_linenumber > 1.8 THEN 'downside with broad participation' END, CASE WHEN l_tax - 0.04 < 0 AND l_quantity / 50 >= 0.55 THEN 'upside against an inverted curve' END], lambda x: x IS NOT NULL), 'string_agg', '; ') AS rules FROM lineitem")
def m04_divergences(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("p_up"), (F.col("l_discount") * 5).alias("rv20"), F.col("l_linenumber").cast("double").alias("adr"), (F.col("l_tax") - 0.04).alias("spr_10y_3m"))
    return report.divergences(rows).select("l_orderkey", "l_linenumber", F.when(F.size("rules") > 0, F.array_join("rules", "; ")).alias("rules"))


@query(_with((_panel_sql(), _LASTQ, "lr AS (SELECT d, ln(close / lag(close) OVER (ORDER BY d)) AS r, row_number() OVER (ORDER BY d DESC) AS n FROM panel WHERE symbol = 'QQQ')", "fx AS (SELECT sum(CAST(price > pc AS INT)) / greatest(1, sum(CAST(price < pc AS INT))) AS adr, avg(CAST(price > m50 AS INT)) AS p50, avg(CAST(price > m200 AS INT)) AS p200, sum(CAST(price >= 0.995 * hi AS INT)) / greatest(1, sum(CAST(price <= 1.005 * lo AS INT))) AS nh, (SELECT stddev_samp(r) * sqrt(252) FROM lr WHERE n <= 20) AS rv20, (SELECT stddev_samp(r) * sqrt(252) FROM lr WHERE n <= 60) AS rv60 FROM lq)"), "SELECT 0 AS place, 'ADR' AS feature, round(adr, 6) + 0 AS x FROM fx UNION ALL SELECT 1, 'Pct>MA50', round(p50, 6) + 0 FROM fx UNION ALL SELECT 2, 'Pct>MA200', round(p200, 6) + 0 FROM fx UNION ALL SELECT 3, 'NH/NL', round(nh, 6) + 0 FROM fx UNION ALL SELECT 4, 'RV20', round(rv20, 6) + 0 FROM fx UNION ALL SELECT 5, 'RV60', round(rv60, 6) + 0 FROM fx UNION ALL SELECT 6, 'SPR_10Y_3M', round(4.2 - 5.1, 6) FROM fx UNION ALL SELECT 7, 'SPR_10Y_2Y', round(4.2 - 4.6, 6) FROM fx UNION ALL SELECT 8, 'CURVATURE', round(4.4 + 5.1 - 8.4, 6) FROM fx"))
def m02_features(spark, sf_dir):
    """All nine features: breadth of the panel, volatility of the base, a curve under the vendor's names."""
    return _features(spark, sf_dir).select("place", "feature", "x")


def _features(spark, sf_dir):
    p = settled_bars(spark, sf_dir)
    rv = report.realized_volatility(p, "QQQ", 20).withColumnRenamed("rv", "rv20").join(report.realized_volatility(p, "QQQ", 60).withColumnRenamed("rv", "rv60"), U)
    raw = spark.createDataFrame([("1998-01-02", "1.0", "1.0", "1.0", "1.0"), ("1998-01-05", "5.1", "4.6", "4.2", "4.4"), ("1998-01-06", None, "4.6", "4.2", "4.4")], "date string, MONTH3 string, `2Y` string, YEAR10 string, Y30 string")
    return report.features_of(report.breadth(report.panel_quotes(p), (U,)), rv, report.curve(report.curve_rows(raw)).withColumn(U, F.lit("core")))


def _model(spark):
    # A made model: equal spreads around means that differ a little by class.
    m = {"mu_up": [1.2, 0.6, 0.6, 1.5, 0.2, 0.2, 0.5, 0.3, 0.1], "mu_dn": [0.8, 0.4, 0.4, 0.8, 0.3, 0.3, 0.1, 0.0, 0.0], "var_up": [0.5, 0.1, 0.1, 1.0, 0.02, 0.02, 1.0, 1.0, 1.0], "var_dn": [0.6, 0.1, 0.1, 1.0, 0.03, 0.03, 1.0, 1.0, 1.0], "prior_up": 0.5989}
    return report.model_rows(spark, m)


@query()
def m01_report(spark, sf_dir):
    """The probability with its bounds, from the nine features."""
    r, _ = report.report_of(_features(spark, sf_dir), _model(spark), 0.2427, 0.3089)
    return r


@query()
def m05_summary(spark, sf_dir):
    """The text of the day and the notes of its drivers."""
    f = _features(spark, sf_dir)
    r, top = report.report_of(f, _model(spark), 0.2427, 0.3089)
    lines = report.summary_lines(r, top, f, U)
    adr = f.filter("feature = 'ADR'").select(U, F.col("x").alias("adr"))
    notes = report.driver_notes(top, r.join(adr, U), U)
    return lines.select(F.lit("summary").alias("part"), F.col("number").cast("int").alias("number"), "line").unionByName(notes.select(F.lit("notes").alias("part"), F.col("rank").alias("number"), F.col("note").alias("line")))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, 'event ' || o_orderkey AS event, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '-' END AS actual, o_orderpriority AS forecast, '-' AS impact FROM orders ORDER BY o_orderdate, 'event ' || o_orderkey LIMIT 8")
def m08_calendar(spark, sf_dir):
    """The first eight events, under other names than their own."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("publishedDate"), F.concat(F.lit("event "), "o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("actual"), F.col("o_orderpriority").alias("consensus"))
    return report.calendar(rows)


@query("SELECT n_regionkey AS snapshot, n_name AS sector, round(CASE WHEN abs(n_nationkey - 12.5) > 5 THEN (n_nationkey - 12.5) / 100 ELSE n_nationkey - 12.5 END, 6) + 0 AS change, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN abs(n_nationkey - 12.5) > 5 THEN (n_nationkey - 12.5) / 100 ELSE n_nationkey - 12.5 END DESC, n_name) AS INT) AS rank FROM nation")
def m07_sector_snapshots(spark, sf_dir):
    """Several snapshots, from JSON rows whose fields go by other names."""
    n = table(spark, sf_dir, "nation")
    raw = n.select("n_regionkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.format_string("%+.1f%%", F.col("n_nationkey") - F.lit(12.5)).alias("changesPercentage"))).alias("value"))
    return report.sectors(ingest.sector_rows(raw.withColumnRenamed("n_regionkey", "snapshot")), ("snapshot",))


_PROB2 = "pb AS (SELECT idx, 1 / (1 + exp(-r * 20)) AS p, lead(close, 5) OVER (ORDER BY idx) / close - 1 AS future FROM q WHERE r IS NOT NULL), pr AS (SELECT *, CASE WHEN future IS NOT NULL THEN CAST((p >= 0.5 AND future > 0) OR (p < 0.5 AND future <= 0) AS INT) END AS ok FROM pb)"


@query(_with((*_TO_Q, _PROB2), f"SELECT count(ok) AS n, {_r('avg(ok)', 'accuracy')}, {_r('avg(CASE WHEN ok IS NOT NULL THEN CAST(future > 0 AS INT) END)', 'up_share')} FROM pr"))
def b16_accuracy(spark, sf_dir):
    d = base(spark, sf_dir).filter("r is not null").withColumn("p", N.sigmoid("r", 20))
    return report.accuracy(report.probability_backtest(d))


@query()
def q06_report_view(spark, sf_dir):
    r, top = report.report_of(_features(spark, sf_dir), _model(spark), 0.2427, 0.3089)
    return snapshot.report_view(r, R.smoothed(frame.records(settled_bars(spark, sf_dir)).select(U, "idx", "d", "stability")), top)


@query()
def k09_summary(spark, sf_dir):
    r, top = report.report_of(_features(spark, sf_dir), _model(spark), 0.2427, 0.3089)
    return sinks.report_summary(r, top).select("number", "line")


@query()
def m09_narrative(spark, sf_dir):
    """Label and text of the last day, from its gates, exposure and the step of the smoothed coupling."""
    p, preset = settled_bars(spark, sf_dir), NEWGATE["base"]
    done = newgate.newgate(p, preset)
    rec = R.smoothed(frame.records(p).select(U, "idx", "stability", "stock_crypto", "traditional", "safe_negative"))
    rows = done.join(rec, [U, "idx"])
    last = rows.withColumn("__n", F.row_number().over(Window.partitionBy(U).orderBy(F.desc("idx")))).filter("__n = 1").drop("__n")
    return narrative.market(last, preset).join(narrative.gate_summary(last).select(U, "risk", F.col("text").alias("gates")), U)


@query("SELECT event_id, " + """CASE WHEN s > 0 THEN CASE WHEN pos >= 0.7 AND dl > 0.01 AND NOT g AND coalesce(sn, 0) <= 0 THEN 'momentum breakout' WHEN pos >= 0.5 AND dl > 0 AND (g OR zr >= 0.9) THEN 'rise with setbacks' ELSE 'gentle rise' END
 WHEN s = 0 THEN CASE WHEN abs(dl) < 0.005 AND NOT rot THEN 'coiling range' WHEN rot THEN 'rotating range' ELSE 'uncertain range' END
 ELSE CASE WHEN sh OR (g AND zr >= 0.9) THEN 'cascade risk' WHEN coalesce(sn, 0) > 0.3 AND sc < 0 AND tr < 0 THEN 'defensive decline' ELSE 'gentle decline' END END AS label
 FROM (SELECT *, ((sc > 0 AND tr < 0) OR (tr > 0 AND sc < 0)) AND abs(sn) < 0.3 AS rot FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 ELSE -1 END AS s, value / 100 AS pos, CAST(event_id % 5 AS DOUBLE) / 100 - 0.02 AS dl, event_id % 2 = 0 AS g, CAST(event_id % 11 AS DOUBLE) / 10 AS zr, event_id % 13 = 0 AS sh, CAST(user_id % 3 AS DOUBLE) / 4 - 0.1 AS sn, CAST(user_id % 4 AS DOUBLE) / 4 - 0.3 AS sc, CAST(user_id % 5 AS DOUBLE) / 4 - 0.4 AS tr FROM events))""")
def m09_labels(spark, sf_dir):
    """All nine labels over made days."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select(
        e, F.when(e % 3 == 0, 1).when(e % 3 == 1, 0).otherwise(-1).alias("state"), (F.col("value") / 100).alias("position"), ((e % 5).cast("double") / 100 - 0.02).alias("delta"), (e % 2 == 0).alias("gated"), (e % 2 == 0).alias("deep"),
        ((e % 11).cast("double") / 10).alias("z_r"), F.lit(0.0).alias("z_dr"), (e % 13 == 0).alias("shocked"), ((u % 3).cast("double") / 4 - 0.1).alias("safe_negative"), ((u % 4).cast("double") / 4 - 0.3).alias("stock_crypto"), ((u % 5).cast("double") / 4 - 0.4).alias("traditional"),
    )
    return rows.select("event_id", narrative.label().alias("label"))


# ---------------------------------------------------------------- text report
@query(_with((*_TO_REC, _EMA), "SELECT CAST(0 AS BIGINT) AS number, 'date' || chr(9) || 'stock-crypto(+)' || chr(9) || 'traditional(+)' || chr(9) || 'Safe-NEG(-)' AS line UNION ALL SELECT row_number() OVER (ORDER BY d), concat_ws(chr(9), strftime(d, '%Y-%m-%d'), printf('%.4f', stock_crypto), printf('%.4f', traditional), printf('%.4f', safe_negative)) FROM rec", True))
def v01_sub_indices(spark, sf_dir):
    return sections.sub_indices(frame.records(bars(spark, sf_dir)))


@query(_with((*_TO_REC, _CLASSIC, _QQQ, _LATCH, "lc AS (SELECT la.*, score, pair_corr, safe_negative FROM la JOIN cl USING (idx))", _SEG.replace("FROM la)", "FROM lc)"), "f AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY idx) AS n FROM sg)"), "SELECT CAST(segment AS BIGINT) AS number, '- ' || strftime(d, '%Y-%m-%d') || ' ' || CASE WHEN state > 0 THEN 'Risk-On' WHEN state < 0 THEN 'Risk-Off' ELSE 'Neutral' END || ' (Score=' || printf('%.4f', score) || ', Corr=' || printf('%.4f', pair_corr) || ', Safe-NEG=' || printf('%.4f', safe_negative) || ')' AS line FROM f WHERE n = 1"))
def v01_timeline(spark, sf_dir):
    """The first row of every run of a latched state, in the Classic form."""
    rec = engines.classic(frame.records(bars(spark, sf_dir))).drop("state")
    return sections.timeline(rec.join(latched(spark, sf_dir).select(U, "idx", "state"), [U, "idx"]))


@query()
def v01_report(spark, sf_dir):
    """The whole text report of the flow engine: ten sections."""
    p = settled_bars(spark, sf_dir)
    states = shared.settled(flow.flow(p, 30, Flow("classic")), "states")
    tested = shared.settled(B.with_levered(B.backtest(states.select(U, "idx", "d", "state", F.col("o_QQQ").alias("open"), F.col("c_QQQ").alias("close")), EXECUTIONS["app"])), "tested")
    span = tested.groupBy(U).agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    corr = R.correlations(p)
    return sinks.report_lines(
        methodology=sections.methodology(spark), stability=sections.stability(states), sub_indices=sections.sub_indices(states), risk_score=sections.scores(states), timeline=sections.timeline(states, "flow"),
        backtest_summary=sections.backtest_summary(B.statistics(tested).join(span, U)), backtest_days=sections.backtest_days(tested), prices=sections.price_lines(states), heat_map=sections.heatmap_lines(sections.heatmap(corr)), pair=sections.pair_lines(R.pair_view(p), "IWM", "BTC-USD"),
    )


@query(_with((*_FITTED_TR, *_test_sql(_CLOSE, 1, 1.0)), f"SELECT idx, {_r('ln(equity)', 'eq_strategy')}, {_r('ln(bench)', 'eq_benchmark')}, {_r('ln(open)', 'price_qqq')} FROM bt"))
def k04_equities(spark, sf_dir):
    """The numbers of the CSV before they are text."""
    t = sinks.backtest_columns(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["golden"]), "idx")
    return t.select("idx", *_log("eq_strategy", "eq_benchmark", "price_qqq"))


# ---------------------------------------------------------------- sources and guards with rows of their own
@query("WITH v AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier), a AS (SELECT 'S' || s_suppkey AS symbol, s_acctbal AS price FROM v WHERE s_suppkey % 2 = 0) SELECT symbol, round(price, 6) + 0 AS price, 1 AS source FROM a WHERE price > 0")
def s05_first_source(spark, sf_dir):
    """Pre-market prices: the first source has some, so the second does not count."""
    s = table(spark, sf_dir, "supplier")
    one = s.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("symbol"), F.col("s_acctbal").alias("pre"), F.lit(-1.0).alias("post"))
    two = s.select(F.concat(F.lit("s"), "s_suppkey").alias("symbol"), F.lit(5.0).alias("pre"), F.lit(6.0).alias("post"))
    return ingest.session_overrides(one, two, F.lit("pre"))


@query("SELECT 'S' || s_suppkey AS symbol, round(s_acctbal, 6) + 0 AS price, 2 AS source FROM supplier WHERE s_acctbal > 0")
def s05_second_source(spark, sf_dir):
    """After hours the first source has no price, so the second one's show."""
    s = table(spark, sf_dir, "supplier")
    one = s.select(F.concat(F.lit("s"), "s_suppkey").alias("symbol"), F.col("s_acctbal").alias("pre"), F.lit(0.0).alias("post"))
    two = s.select(F.concat(F.lit("s"), "s_suppkey").alias("symbol"), F.lit(5.0).alias("pre"), F.col("s_acctbal").alias("post"))
    return ingest.session_overrides(one, two, F.lit("post"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN round(o_totalprice, 6) WHEN o_custkey % 3 > 0 THEN round(o_custkey, 6) END + 0 AS price FROM orders WHERE o_totalprice > 100000 OR o_custkey % 3 > 0")
def s04_quotes(spark, sf_dir):
    """A positive price, else a positive previous close, else nothing."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("symbol"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).otherwise(0.0).alias("price"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("double")).alias("prev_close"))
    return ingest.quotes(rows).select(F.col("symbol").alias("o_orderkey"), "price")


@query("SELECT 'S' || s_suppkey AS symbol, CAST(min(b) AS INT) AS basket, arg_min(p, b) AS position FROM (SELECT s_suppkey, 0 AS b, s_suppkey AS p FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 1, s_suppkey * 10 FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY s_suppkey")
def s15_holdings(spark, sf_dir):
    """Where a symbol is first seen over two baskets; ill-formed ones go."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = F.concat(F.lit(" s"), k)
    one = s.filter(k % 2 == 0).select(name.alias("symbol"), k.alias("position"))
    two = s.filter(k % 3 == 0).select(F.explode(F.array(F.concat(F.lit("S"), k), F.lit("not a symbol"))).alias("symbol"), (k * 10).alias("position"))
    return ingest.holdings(one, two)


@query("SELECT 'SYM' || p_partkey AS symbol, round(p_retailprice, 2) + 0 AS price FROM part WHERE p_partkey % 4 > 0")
def s14_overrides(spark, sf_dir):
    """JSON objects of overrides; entries that are no numbers are passed over."""
    k = F.col("p_partkey")
    value = F.format_string('{" sym%d ": "%s"}', k, F.when(k % 4 > 0, F.format_string("+%.2f", "p_retailprice")).otherwise("none"))
    return ingest.overrides(table(spark, sf_dir, "part").select(value.alias("value")))


@query("SELECT CAST(o_orderdate AS DATE) AS d, round(o_custkey / 1000.0, 3) + 0 AS stability, round(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey / 2000.0 ELSE round(o_custkey / 1000.0, 3) END, 4) + 0 AS smoothed FROM orders WHERE o_orderkey % 5 > 0")
def s11_text_table(spark, sf_dir):
    """Tab-separated lines, some of them no rows, some without a smoothed value."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = F.when(k % 5 == 0, F.concat(F.lit("# "), day)).otherwise(F.concat_ws("\t", day, F.format_string("%.3f x", F.col("o_custkey") / 1000), F.when(k % 3 > 0, F.format_string("%.4f", F.col("o_custkey") / 2000)).otherwise("-"), F.lit("0")))
    return ingest.text_table(table(spark, sf_dir, "orders").select(line.alias("value"))).select("d", "stability", "smoothed")


@query("WITH n AS (SELECT p_partkey AS k, unnest(range(p_partkey % 5)) AS i FROM part WHERE p_partkey <= 200) SELECT 'P' || k AS symbol, DATE '1998-01-01' + CAST(i AS INT) AS d, round(CASE WHEN i % 2 = 0 THEN k + i / 10.0 END, 6) + 0 AS open, round(k + i / 10.0 + CASE WHEN i = 3 THEN 1 ELSE 0 END, 6) + 0 AS close FROM n WHERE i % 2 = 0 OR i = 3")
def s06_chart_rows(spark, sf_dir):
    """Chart arrays: the adjusted close where there is one, else the close; days without either go."""
    k = F.col("p_partkey")
    steps = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < k % 5)
    raw = table(spark, sf_dir, "part").filter("p_partkey <= 200").select(
        F.concat(F.lit("P"), k).alias("symbol"), F.transform(steps, lambda i: (F.lit(883612800) + i * 86400).cast("long")).alias("timestamp"),
        F.transform(steps, lambda i: F.when(i % 2 == 0, k + i / 10)).alias("close"), F.transform(steps, lambda i: F.when(i == 3, k + i / 10 + 1)).alias("adjclose"),
    )
    return ingest.chart_rows(raw).select("symbol", "d", "open", "close")


@query(_with((_panel_sql(),), f"SELECT symbol, d, {_logs('close')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS n FROM panel) WHERE n <= 31"))
def p06_row_before(spark, sf_dir):
    """The last thirty rows and the one before them."""
    return ingest.with_row_before(bars(spark, sf_dir), 30, by=("universe", "symbol")).select("symbol", "d", *_log("close"))


@query(_with((_panel_sql(),), f"SELECT symbol, d, {_logs('close')} FROM panel WHERE d < DATE '1998-06-01'"))
def p12_effective_days(spark, sf_dir):
    return filters.effective_days(bars(spark, sf_dir), F.lit("1998-06-01").cast("date"), False).select("symbol", "d", *_log("close"))


@query(_with((_panel_sql(),), "SELECT symbol, d + CAST(DATE '2005-01-01' - max(d) OVER () AS INT) AS d FROM panel"))
def p18_shifted_days(spark, sf_dir):
    return filters.shifted_days(bars(spark, sf_dir), F.lit("2005-01-01").cast("date")).select("symbol", "d")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ADR' WHEN 1 THEN 'NH/NL' WHEN 2 THEN 'Pct>MA50' ELSE 'RV20' END AS feature, round(CASE p_partkey % 4 WHEN 0 THEN least(greatest(p_size / 8.0, 0.05), 5) WHEN 1 THEN least(greatest(p_size / 5.0 - 2, 0.05), 8) WHEN 2 THEN least(greatest(p_size / 25.0 - 0.5, 0), 1) ELSE p_size / 3.0 END, 6) + 0 AS x FROM part")
def p16_clamped(spark, sf_dir):
    k, z = F.col("p_partkey") % 4, F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "ADR").when(k == 1, "NH/NL").when(k == 2, "Pct>MA50").otherwise("RV20").alias("feature"), F.when(k == 0, z / 8).when(k == 1, z / 5 - 2).when(k == 2, z / 25 - 0.5).otherwise(z / 3).alias("x"))
    return report.clamped(rows)


@query(_with(_TO_Q, f"SELECT idx, {_r('CASE WHEN len(h) >= 5 THEN nullif(1.4826 * list_sort(list_transform(h, lambda v: abs(v - m)))[len(h) // 2 + 1], 0) END', 'sigma')} FROM (SELECT idx, h, list_sort(h)[len(h) // 2 + 1] AS m FROM (SELECT idx, list(r) FILTER (WHERE r IS NOT NULL) OVER (ORDER BY idx ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS h FROM q))"))
def w19_upper_mad(spark, sf_dir):
    """The robust deviation from upper medians."""
    d = base(spark, sf_dir)
    return folds.per_series(d, lambda p: {"sigma": folds.upper_mad_values(p["r"], 126)}, {"sigma": "double"}).select("idx", N.finite("sigma").alias("sigma"))


@query("SELECT event_id, round(1 / (1 + exp(-0.85 * value / 10)), 6) + 0 AS sig, round(tanh(value / 40), 6) + 0 AS th, round(greatest(0.1, 1 / (1 + exp(4 * (value / 100 - 0.5)))) / (greatest(0.1, 1 / (1 + exp(4 * (value / 100 - 0.5)))) + greatest(0.1, 1 / (1 + exp(4 * (0.5 - value / 100))))), 6) + 0 AS soft, round(least(greatest((value - 20) / 40, 0), 1), 6) + 0 AS part FROM events")
def n05_ramps(spark, sf_dir):
    """Sigmoid, tanh, the floored softmax of two, and the share of a range."""
    v = F.col("value")
    a, _ = N.softmax2(F.lit(0.5), v / 100, 4.0, 0.1)
    return table(spark, sf_dir, "events").select("event_id", N.sigmoid(v / 10, 0.85).alias("sig"), N.tanh_clip(v, 40).alias("th"), a.alias("soft"), N.normalize_range(v, 20, 60).alias("part"))


@query()
def a28_platt(spark, sf_dir):
    """The calibration of a probability made from yesterday's return against today's sign."""
    d = base(spark, sf_dir).withColumns({"p": N.sigmoid(F.lag("r").over(W.series(U)), 40), "y": (F.col("r") > 0).cast("int")}).filter("p is not null and y is not null")
    a, b = report.fit_platt(d.select("p", "y"))
    return spark.createDataFrame([(a, b)], "a double, b double")


@query("SELECT o_orderkey, round(greatest(o_totalprice / 512345.678 - (least(greatest(0.16 - 0.08 * least(1, o_custkey / 1000.0), 0.04), 0.22)) / 2, 0), 6) + 0 AS low, round(least(o_totalprice / 512345.678 + (least(greatest(0.16 - 0.08 * least(1, o_custkey / 1000.0), 0.04), 0.22)) / 2, 1), 6) + 0 AS high FROM orders")
def a32_interval(spark, sf_dir):
    low, high = report.interval(F.col("o_totalprice") / 512345.678, F.col("o_custkey") / 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", low.alias("low"), high.alias("high"))


@query(_with(_TO_Q, f"SELECT idx, {_r('CASE WHEN idx % 5 = 2 THEN ln(idx) ELSE ln(first_value(close) OVER w) + sum(ln(1 + CASE WHEN sr IS NULL THEN 0 ELSE least(greatest(0.5 * sr, -0.99), 5) END)) OVER w - ln(1000) END', 'levered')} FROM q WINDOW w AS (ORDER BY idx ROWS UNBOUNDED PRECEDING)"))
def j12_levered_prices(spark, sf_dir):
    """The levered asset's price: the real one every fifth day, the compounded one on the others."""
    a = align.align(bars(spark, sf_dir))
    made = folds.synthetic_levered(a, leverage=0.5).withColumn("levered", F.col("levered") / 1000)
    real = a.filter("symbol = 'QQQ' and idx % 5 in (2, 3)").withColumn("close", F.when(F.col("idx") % 5 == 2, F.col("idx").cast("double")))
    return align.levered_prices(made, real).select("idx", *_log("levered"))


@query(_with((_panel_sql(), "lr AS (SELECT d, ln(close / lag(close) OVER (ORDER BY d)) AS r, row_number() OVER (ORDER BY d DESC) AS n FROM panel WHERE symbol = 'IWM')"), f"SELECT {_r('stddev_pop(r) * sqrt(252)', 'rv')} FROM lr WHERE n <= 60"))
def a26_population_volatility(spark, sf_dir):
    return report.realized_volatility(bars(spark, sf_dir), "IWM", 60, population=True).select("rv")


@query(_with((*_TO_Q, _LATCH, _SEG, "runs AS (SELECT segment, any_value(state) AS state, min(d) AS d, arg_min(close, idx) AS p0, arg_max(close, idx) AS p1 FROM sg GROUP BY segment)", "nx AS (SELECT segment, state, d, p0, lag(state) OVER o AS ps, coalesce(lead(p0) OVER o, p1) AS pe FROM runs WINDOW o AS (ORDER BY segment))",
              "sc AS (SELECT d, idx / 10000.0 AS score, idx / 20000.0 AS w FROM q WHERE idx % 7 = 0)", "lb AS (SELECT -1 AS s, 'Risk-Off' AS l UNION ALL SELECT 0, 'Neutral' UNION ALL SELECT 1, 'Risk-On')",
              "ln AS (SELECT row_number() OVER (ORDER BY segment DESC) AS number, d, ps, state, pe / p0 - 1 AS r FROM nx WHERE ps IS NOT NULL ORDER BY segment DESC LIMIT 10)",
              "al2 AS (SELECT number, d, strftime(d, '%m/%d') || chr(9) || a.l || ' > ' || b.l || chr(9) || printf('%.2f%%', r * 100) AS h FROM ln JOIN lb a ON a.s = ps JOIN lb b ON b.s = state UNION ALL SELECT 0, d, strftime(d, '%m/%d') || chr(9) || 'now ' || l FROM la JOIN lb ON s = state WHERE idx = (SELECT max(idx) FROM la))"),
             "SELECT CAST(number AS BIGINT) AS number, h || chr(9) || 'score ' || printf('%.3f', (SELECT arg_max(score, sc.d) FROM sc WHERE sc.d <= al2.d)) || ', trend ' || printf('%.2f', (SELECT arg_max(w, sc.d) FROM sc WHERE sc.d <= al2.d)) AS line FROM al2"))
def q10_scored_lines(spark, sf_dir):
    """The state of today and the last ten changes, each with the score known on its day: scores come every seventh row."""
    la = latched(spark, sf_dir)
    scores = la.filter("idx % 7 = 0").select(U, "d", (F.col("idx") / 10000).alias("score"), (F.col("idx") / 20000).alias("w_trend"))
    last = la.groupBy(U).agg(F.max("d").alias("d"), F.max_by("state", "idx").alias("state"))
    return narrative.scored_lines(islands.transitions(la, "state", "close"), scores, last)
