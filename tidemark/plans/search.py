"""Parameter search: candidates are scored in parallel and ranked by one aggregation.

Daily columns that no candidate changes are made once.  ClassicFlux5 hands a history to one task per block of
candidates, which tries them one after the other.  The flow engine's flags are columns, so its candidates
are rows beside the days of a history; a day of a history has as many rows as there are candidates, and
candidates are a list of bounded length that travels in the plan.  What no candidate changes is made before, only the columns
that rules read are multiplied, and candidates that differ in nothing the engine reads are run once.  Parts of the history
(train and test, segments, splits) are universes of their own, cut from the panel before anything is fitted.  ``budgeted``
spends a count and a time: parts are rounds, candidates of a round are dealt in blocks, and the poorer ones drop out after it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Execution, Flow
from tidemark.functions.numeric import mulberry32
from tidemark.plans import flow as flow_plan
from tidemark.plans.backtest import backtest, statistics
from tidemark.plans.flux5 import INPUTS
from tidemark.plans.flux5 import fold as flux5_fold
from tidemark.sources import shared

U = "universe"
# Axes of the searches and bounds of their draws.
FLUX5_GRID = {"v_on": [0.05, 0.10], "v_off": [-0.05, 0.0], "pcon_on": [0.55, 0.60, 0.65], "pcon_off": [0.40, 0.45, 0.50], "mm_hi": [0.90, 0.92], "down_all": [0.60, 0.65], "drift_days": [3, 5], "k_on": [0.55, 0.60, 0.65]}
EXP_GRID = {"macro_on": [0.45], "macro_off": [0.35], "q_on": [0.70, 0.72], "q_off": [0.18], "a_s": [0.20, 0.25], "confirm_off": [1, 2], "hazard_drop": [0.03]}
EXP_BOUNDS = {"macro_on": (0.44, 0.52), "macro_off": (0.28, 0.38), "q_on": (0.65, 0.80), "q_off": (0.10, 0.25), "a_s": (0.10, 0.35), "a_j": (0.05, 0.15), "b_s": (0.10, 0.30), "b_j": (0.05, 0.15), "hazard_drop": (0.02, 0.05)}

# Parameters and columns of a day that the flow engine's rules read.
READ = ("q_on", "q_off", "fast", "slow", "z_win", "z_up", "z_down", "slope_min", "neutral_lo", "neutral_hi", "lag_up", "lag_down", "up_confirm_off")
DAY = (
    "mm", "j", "diffusion", "pcon", "combo", "guard", "v_pc1", "breadth", "bench10", "bench20", "down_all", "day0", "day0_both", "pair_corr", "apdf", "rb", "risk3", "mm_trend", "frob_z", "flux_slope", "stability", "o_QQQ", "c_QQQ",
)


def grid(**values: list[float]) -> list[dict[str, float]]:
    """Every combination, as ``candidate`` and its parameters."""
    return [{"candidate": i} | {k: float(v) for k, v in zip(values, c)} for i, c in enumerate(product(*values.values()))]


def random_candidates(spark: SparkSession, n: int, seed: int = 42, **bounds: tuple[float, float]) -> DataFrame:
    """``n`` candidates drawn evenly within bounds; one seed gives one list."""
    draw = np.random.default_rng(seed).uniform(size=(n, len(bounds)))
    rows = [(i, *(float(lo + x * (hi - lo)) for x, (lo, hi) in zip(r, bounds.values()))) for i, r in enumerate(draw)]
    return spark.createDataFrame(rows, "candidate long, " + ", ".join(f"{k} double" for k in bounds))


def drawn_exp(n: int, seed: int = 42) -> list[dict[str, float]]:
    """``n`` candidates within ``EXP_BOUNDS`` whose on and off parameters stay apart; one seed gives one list."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        c = {k: round(float(rng.uniform(a, b)), 3) for k, (a, b) in EXP_BOUNDS.items()}
        if c["macro_off"] < c["macro_on"] - 0.04 and c["q_off"] < c["q_on"] - 0.08:
            out.append({"candidate": len(out)} | c)
    return out


def drawn_stab(n: int, cycle_rows: int, seed: int = 42) -> list[dict[str, float]]:
    """``n`` overlays around a cycle length; one seed gives one list, draw by draw that of the published tuner."""
    draw, out = mulberry32(seed), []
    between = lambda low, high: int(np.floor(low + next(draw) * (high - low + 1)))
    real = lambda low, high: low + next(draw) * (high - low)
    whole = lambda x, least, most, low, high: int(min(max(np.floor(x + 0.5) + between(least, most), low), high))
    for i in range(n):
        fast = whole(0.30 * cycle_rows, -3, 3, 7, 42)
        slow = whole(0.90 * cycle_rows, -5, 5, max(2 * fast, 30), 126)
        c = {"candidate": i, "fast": fast, "slow": slow, "z_win": whole(2.0 * slow, -10, 10, 63, 210), "z_up": real(1.4, 2.2), "z_down": real(1.4, 2.2), "slope_min": real(0.010, 0.020)}
        c |= {"lag_up": whole(0.15 * fast, 0, 2, 2, 8), "lag_down": whole(0.20 * fast, 0, 3, 3, 10), "lead_on": whole(0.25 * fast, 0, 2, 3, 10), "down_grace": whole(0.25 * fast, 0, 2, 3, 10), "hazard": whole(0.35 * fast, 0, 3, 4, 14)}
        for _ in range(5):  # parameters that the engine does not read
            next(draw)
        out.append(c | {"neutral_lo": 0.30, "neutral_hi": 0.40, "up_confirm_off": 2})
    return out


def in_parts(panel: DataFrame, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """The panel once for each part of the calendar, ``universe/part`` being the universe."""
    day = lambda x: F.lit(x).cast("date")
    held = F.filter(F.array(*(F.when(F.col("d").between(day(a), day(b)), name) for name, (a, b) in parts.items())), lambda x: x.isNotNull())
    return panel.select("*", F.explode(held).alias("__part")).withColumn(U, F.concat_ws("/", U, "__part")).drop("__part")


def part_of(universe: str = U) -> Column:
    return F.element_at(F.split(universe, "/"), -1)


def search_flux5(inputs: DataFrame, candidates: list[dict[str, float]], leverage: float = 3.0, block: int = 64) -> DataFrame:
    """``candidate, universe, n, log_equity, max_drawdown, transitions`` of the ClassicFlux5 thresholds.

    ``inputs`` comes from ``flux5.inputs``.  A history is dealt once for each block of candidates.
    """
    blocks = -(-len(candidates) // block)
    rows = inputs.select(U, "idx", F.col("s_QQQ").alias("ret"), *INPUTS, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        ret, out = pdf["ret"].fillna(0).to_numpy(), []
        first = int(pdf["block"].iloc[0]) * block
        for c in candidates[first : first + block]:
            state = np.array(flux5_fold(pdf, **{k: v for k, v in c.items() if k != "candidate"}))
            held = np.concatenate([[0], state[:-1]])
            log_equity = np.cumsum(np.log1p(np.where(held > 0, np.maximum(-0.99, leverage * ret), np.where(held < 0, 0.0, ret))))
            out.append((int(c["candidate"]), pdf[U].iloc[0], len(pdf), log_equity[-1], np.exp((log_equity - np.maximum.accumulate(log_equity)).min()) - 1, int((np.diff(state) != 0).sum())))
        return pd.DataFrame(out, columns=["candidate", U, "n", "log_equity", "max_drawdown", "transitions"])

    return rows.groupBy(U, "block").applyInPandas(run, f"candidate long, {U} string, n long, log_equity double, max_drawdown double, transitions long")


def _beside(rows: DataFrame, candidates: list[dict[str, float]]) -> DataFrame:
    """Every row once for each candidate, whose parameters become columns; ``universe`` ends with the candidate."""
    schema = ", ".join(f"{k} {'long' if k == 'candidate' else 'double'}" for k in candidates[0])
    listed = F.explode(F.from_json(F.lit(json.dumps(candidates)), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))).alias("__c")
    return rows.select("*", listed).select("*", "__c.*").drop("__c").withColumn(U, F.concat_ws("/", U, F.col("candidate").cast("string")))


def _tested(done: DataFrame, e: Execution) -> DataFrame:
    """Statistics of each candidate and part."""
    d = statistics(backtest(done.select(U, "idx", "d", "state", F.col("o_QQQ").alias("open"), F.col("c_QQQ").alias("close")), e))
    parts = F.split(U, "/")
    return d.select(F.element_at(parts, -1).cast("long").alias("candidate"), F.element_at(parts, -2).alias("part"), F.array_join(F.slice(parts, 1, F.size(parts) - 2), "/").alias(U), *(c for c in d.columns if c != U))


def quantile_thresholds(rows: DataFrame, p: Flow) -> DataFrame:
    """``universe, on, off`` for the columns ``q_on, q_off`` of each universe: one pass over a series, bounded by its calendar."""

    j_on, j_off, least = p.j_on, p.j_off, p.quantile_rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        j = pdf["j"].dropna()
        on, off = (j.quantile(pdf["q_on"].iloc[0]), j.quantile(pdf["q_off"].iloc[0])) if len(j) >= least else (j_on, j_off)
        return pd.DataFrame({U: [pdf[U].iloc[0]], "on": [max(j_on, on)], "off": [min(j_off, off)]})

    return rows.select(U, "j", "q_on", "q_off").groupBy(U).applyInPandas(run, f"{U} string, on double, off double")


def _alike(candidates: list[dict[str, float]]) -> tuple[list[dict[str, float]], dict[int, int]]:
    """One candidate for each set of values that the engine reads, and for every candidate the one that is run for it."""
    first, leader = {}, {}
    for c in candidates:
        leader[c["candidate"]] = first.setdefault(tuple(c.get(k) for k in READ), c)["candidate"]
    return list(first.values()), leader


def search_flow(cols: DataFrame, candidates: list[dict[str, float]], p: Flow, e: Execution) -> DataFrame:
    """Statistics of the flow engine for candidates of ``q_on, q_off`` or of its stability overlay.

    ``cols`` is ``flow.columns`` of a panel from ``in_parts``.
    """
    run, leader = _alike(candidates)
    used = [c for c in DAY if c in cols.columns]
    before = not {"fast", "slow", "z_win"} & set(run[0])
    days = flow_plan.timed(cols.select(U, "idx", "d", *used), p) if before else cols.select(U, "idx", "d", *used)
    rows = _beside(days, [{k: v for k, v in c.items() if k == "candidate" or k in READ} for c in run])
    if "q_on" not in run[0]:
        rows = rows.withColumns({"q_on": F.lit(p.q_on), "q_off": F.lit(p.q_off)})
    rows = rows.join(quantile_thresholds(rows, p), U)
    stab = {k: F.col(k) for k in ("z_up", "z_down", "slope_min", "neutral_lo", "neutral_hi", "lag_up", "lag_down", "up_confirm_off") if k in run[0]}
    q = p.with_(stab=replace(p.stab, **stab)) if stab else p
    flagged = flow_plan.conditions(rows, F.col("on"), F.col("off"), q, made=before)
    kept = flagged.select(U, "idx", "d", "j", "guard", "o_QQQ", "c_QQQ", "raw_on", "raw_off", "confirm", "need_off", "drift", "flat")
    done = _tested(flow_plan.states(kept, p), e)
    if len(run) == len(candidates):
        return done
    names = done.columns
    followers = done.sparkSession.createDataFrame([(v, k) for k, v in leader.items()], "__leader long, candidate long")
    return done.withColumnRenamed("candidate", "__leader").join(followers, "__leader").select(names)


# ---------------------------------------------------------------- rounds under a budget
def _written(jobs: dict[str, DataFrame], until: float | None, at_once: int) -> list[str]:
    """Write every table of ``jobs`` (path, rows), some at once; what is not done at ``until`` is cancelled by its tag and left out."""
    if not jobs:
        return []
    spark = next(iter(jobs.values())).sparkSession
    sc, tag = spark.sparkContext, f"search-{uuid.uuid4().hex}"
    over = lambda: until is not None and time.monotonic() >= until

    def one(path: str, rows: DataFrame) -> str | None:
        if over():
            return None
        sc.addJobTag(tag)
        try:
            rows.write.parquet(path)
            return path
        except Exception:
            if over():
                return None
            raise
        finally:
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(at_once) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(one), *job) for job in jobs.items()]
        running = wait(runs, None if until is None else max(0.0, until - time.monotonic())).not_done
        while running:  # a table may take several jobs
            sc.cancelJobsWithTag(tag)
            running = wait(running, 0.2).not_done
    return [r.result() for r in runs if r.result()]


def budgeted(
    spark: SparkSession, evaluate: Callable[[list[dict[str, float]], str], DataFrame], objective: Callable[[DataFrame], DataFrame], candidates: list[dict[str, float]], parts: list[str],
    count: int | None = None, seconds: float | None = None, keep: float = 0.5, block: int = 50, at_once: int = 4,
) -> DataFrame:
    """``candidate, rounds, objective, place``: the search under a count and a time.

    The first ``count`` candidates are tried.  Every part is a round: ``evaluate(block, part)`` gives the statistics of a block of
    candidates, written as a table of its own; ``objective(statistics)`` gives ``candidate, objective`` over the parts
    so far.  The share ``keep`` with the best objectives goes on (at least one; ties to the smaller number), so with 1.0 this is the full search and with less
    it may lose a candidate that is poor in early parts.  After ``seconds`` no block starts, running ones are cancelled, and
    candidates keep what was measured.  ``place`` orders by rounds, objective and number; candidates without a
    measured part stand last, their objective is NULL.  The driver holds one number a candidate.
    """
    until = None if seconds is None else time.monotonic() + seconds
    tried = candidates if count is None else candidates[:count]
    alive, rounds, found, paths = list(tried), {c["candidate"]: 0 for c in tried}, {}, []
    for part in parts:
        if not alive or (until is not None and time.monotonic() >= until):
            break
        blocks = [alive[i : i + block] for i in range(0, len(alive), block)]
        names = {f"{shared.folder(spark)}/search-{uuid.uuid4().hex}": b for b in blocks}
        done = _written({path: evaluate(b, part) for path, b in names.items()}, until, at_once)
        paths += done
        scored = {c["candidate"] for path in done for c in names[path]}
        if scored:
            found |= {r["candidate"]: r["objective"] for r in objective(spark.read.parquet(*paths)).select("candidate", "objective").collect() if r["candidate"] in scored}
        rounds |= {c: rounds[c] + 1 for c in scored}
        if len(done) < len(blocks):
            break
        ranked = sorted(alive, key=lambda c: (found.get(c["candidate"]) is None, -(found.get(c["candidate"]) or 0.0), c["candidate"]))
        alive = ranked[: max(1, int(np.ceil(keep * len(ranked))))]
    order = sorted(rounds, key=lambda c: (-rounds[c], found.get(c) is None, -(found.get(c) or 0.0), c))
    return spark.createDataFrame([(c, rounds[c], found.get(c), i + 1) for i, c in enumerate(order)], "candidate long, rounds int, objective double, place int")


# ---------------------------------------------------------------- objectives
def objective_blended(stats: DataFrame) -> DataFrame:
    """``objective``: 3 cagr + 0.5 hit rate - 1.2 of the drawdown beyond 0.45 - 0.01 changes a year; 0 counts as missing."""
    or_ = lambda c, missing: F.when(F.coalesce(c, F.lit(0.0)) == 0, missing).otherwise(c)
    deep = F.greatest(F.lit(0.0), or_(-F.col("max_drawdown"), 1.0) - 0.45)
    return stats.withColumn("objective", 3.0 * F.coalesce("cagr", F.lit(0.0)) + 0.5 * or_(F.col("hit_rate"), 0.45) - 1.2 * deep - 0.01 * or_(F.col("churn"), 20.0))


def objective_exp(stats: DataFrame) -> DataFrame:
    """``objective``: cagr + 0.3 (on hit rate - 0.5) - 0.4 drawdown - 0.2 of the share of rows that change the state."""
    flips = F.col("transitions") / F.greatest(F.lit(1), F.col("n"))
    return stats.withColumn("objective", F.col("cagr") + 0.3 * (F.coalesce("on_hit_rate", F.lit(0.0)) - 0.5) + 0.4 * F.col("max_drawdown") - 0.2 * flips)


def objective_segments(stats: DataFrame, by: tuple[str, ...] = ("candidate",)) -> DataFrame:
    """One row a candidate from its segments: log of the geometric mean gain + 0.4 (mean on hit rate - 0.5) - 0.4 mean drawdown - 0.15 share of changes."""
    gain = F.exp(F.avg(F.greatest(F.col("log_equity"), F.lit(float(np.log(1e-6)))))) - 1
    churn = F.sum("transitions") / F.greatest(F.lit(1), F.sum("n"))
    score = F.ln(1 + F.greatest(gain, F.lit(-0.8))) + 0.4 * (F.avg(F.coalesce("on_hit_rate", F.lit(0.0))) - 0.5) + 0.4 * F.avg("max_drawdown") - 0.15 * churn
    return stats.groupBy(*by).agg(score.alias("objective"))


def best(stats: DataFrame, score: str = "log_equity") -> DataFrame:
    """The best candidate of each universe and part; among equals the first."""
    keys = [c for c in (U, "part") if c in stats.columns]
    order = F.struct(F.col(score).alias("score"), (-F.col("candidate")).alias("first"))
    return stats.groupBy(*keys).agg(F.max_by("candidate", order).alias("candidate"), F.max(score).alias(score))


def _round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def _within(c: Column, low: Column | int, high: int) -> Column:
    return F.least(F.greatest(c, low if isinstance(low, Column) else F.lit(low)), F.lit(high)).cast("int")


def cycle_windows(cycles: DataFrame) -> DataFrame:
    """``fast, slow, z_win``, lags and windows of the overlay from ``universe, cycle`` (a length in rows)."""
    c = F.col("cycle")
    d = cycles.withColumn("fast", _within(_round(0.7 * c), 14, 42))
    d = d.withColumn("slow", _within(_round(2.1 * c), F.greatest(2 * F.col("fast"), F.lit(40)), 126))
    part = lambda share, low, high: _within(F.ceil(share * c), low, high)
    return d.withColumns({
        "z_win": _within(_round(2.0 * F.col("slow")), 63, 252), "lag_up": part(0.10, 2, 6), "lag_down": part(0.13, 3, 8), "lead_on": part(0.17, 3, 8), "down_grace": part(0.17, 3, 8), "hazard": part(0.27, 4, 12),
    })


def stability_parameters(records: DataFrame, cycles: DataFrame) -> DataFrame:
    """The whole overlay of each universe from its cycle and its slope's own distribution.

    ``slope_min`` is the 0.6 quantile of the absolute slope within 0.008 and 0.020; the z thresholds are the 0.9 quantile
    of the absolute slope over its deviation, within 1.4 and 2.5.
    """
    from tidemark.operators.folds import ema_values, per_series

    windows = cycle_windows(cycles)
    rows = records.select(U, "idx", "smoothed").join(windows.select(U, "fast", "slow"), U)

    def fold(pdf: pd.DataFrame) -> dict:
        return {"slope": ema_values(pdf["smoothed"], int(pdf["fast"].iloc[0])) - ema_values(pdf["smoothed"], int(pdf["slow"].iloc[0]))}

    size = F.abs("slope")
    q = per_series(rows, fold, {"slope": "double"}).groupBy(U).agg(F.percentile(size, 0.6).alias("q60"), F.percentile(size, 0.9).alias("q90"), F.stddev_samp(size).alias("sd"))
    z = F.least(F.greatest(F.coalesce(F.try_divide("q90", "sd"), F.lit(1.8)), F.lit(1.4)), F.lit(2.5))
    return windows.join(q, U).select(
        U, "cycle", "fast", "slow", "z_win", F.round(z, 2).alias("z_up"), F.round(z, 2).alias("z_down"), F.round(F.least(F.greatest("q60", F.lit(0.008)), F.lit(0.020)), 4).alias("slope_min"),
        F.lit(0.30).alias("neutral_lo"), F.lit(0.40).alias("neutral_hi"), "lag_up", "lag_down", "lead_on", "down_grace", "hazard",
    )
