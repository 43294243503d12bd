"""Texts about the state of the day: labels, gate summaries, transition lines, the narrative."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Newgate, Stab
from tidemark.operators.align import as_of
from tidemark.operators.folds import ema_values, opened, per_series, upper_mad_values
from tidemark.operators.islands import executed
from tidemark.operators.rolling import series
from tidemark.functions.text import fixed, month_day, percent_points, state_text, tsv

U = "universe"


def label() -> Column:
    """One of nine labels from ``state, position, delta, gated, deep, z_r, z_dr, shocked, safe_negative, stock_crypto, traditional``."""
    zero, holds = lambda c: F.coalesce(c, F.lit(0.0)), lambda c: F.coalesce(c, F.lit(False))
    s, pos, delta, safe, coin, plain = (F.col(c) for c in ("state", "position", "delta", "safe_negative", "stock_crypto", "traditional"))
    gated, joined = holds(F.col("gated")), holds((zero("z_r") >= 0.90) | (zero("z_dr") >= 1.00))
    apart = holds(((coin > 0) & (plain < 0)) | ((plain > 0) & (coin < 0))) & F.coalesce(F.abs(safe) < 0.3, F.lit(True))
    up = F.when(holds(pos >= 0.70) & (zero(delta) > 0.01) & ~gated & (zero(safe) <= 0), "momentum breakout").when(holds(pos >= 0.50) & (zero(delta) > 0) & (gated | joined), "rise with setbacks").otherwise("gentle rise")
    flat = F.when(holds(F.abs(delta) < 0.005) & ~apart, "coiling range").when(apart, "rotating range").otherwise("uncertain range")
    down = F.when(holds(F.col("shocked")) | (holds(F.col("deep")) & joined), "cascade risk").when((zero(safe) > 0.30) & (zero(coin) < 0) & (zero(plain) < 0), "defensive decline").otherwise("gentle decline")
    return F.when(s > 0, up).when(F.coalesce(s, F.lit(0)) == 0, flat).otherwise(down)


def market(last: DataFrame, p: Newgate) -> DataFrame:
    """``label, text`` of the last row of ``newgate`` joined with the smoothed record."""
    caps = {"cap_ew": F.when(F.col("ew_hits") >= 2, p.g1).otherwise(1.0), "cap_dr": F.when(F.col("dr_hits") >= 2, p.g2).otherwise(1.0), "cap_cr": F.when(F.col("cr_held") > 0, p.g3).otherwise(1.0)}
    d = last.withColumns(caps).withColumn("cap", F.least("shock", *caps))
    d = d.withColumns({"gated": F.col("cap") < 1, "deep": F.col("cap_dr") < 1, "shocked": F.col("shock") < 1})
    two = lambda c: fixed(c, 2)
    bound = F.when(F.col("cap") >= 0.95, "free").when(F.col("cap") >= 0.60, "partly bound").otherwise("strongly bound")
    moved = F.when(F.col("position") >= 0.70, "strong momentum").when(F.col("position") >= 0.50, "gentle momentum").otherwise("weak momentum")
    slope = F.when(F.col("delta") > 0, "rising").when(F.col("delta") < 0, "falling").otherwise("level")
    odd = F.concat_ws("; ", *(F.when(F.coalesce(c, F.lit(False)), t) for c, t in (
        ((F.col("state") > 0) & ((F.col("cap") < 0.95) | (F.col("z_r") >= 0.9) | (F.col("z_dr") >= 1.0) | (F.col("fqi") < 0)), "rising under gates or coupling"),
        ((F.col("state") < 0) & (((F.col("w_trend") >= 0.60) & (F.col("delta") > 0)) | (F.col("fqi") > 0.10) | (F.col("z_eta") < -0.4)), "weak with signs of recovery"),
    )))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("- Reading: "), label()),
        F.concat(F.lit("- Gates: cap "), two("cap"), F.format_string(", EW %d/5 (%s), DR %d/4 (%s), CR %d/5 (%s), shock ", "ew_hits", two("cap_ew"), "dr_hits", two("cap_dr"), "cr_hits", two("cap_cr")), F.when(F.col("shocked"), "on").otherwise("off")),
        F.concat(F.lit("- Trend: smoothed "), two("smoothed"), F.lit(", delta "), two("delta"), F.lit(", position "), fixed("position", 3), F.lit(", trend weight "), two("w_trend")),
        F.concat(F.lit("- Money: stock-crypto "), two("stock_crypto"), F.lit(", traditional "), two("traditional"), F.lit(", Safe-NEG "), two("safe_negative")),
        F.concat(F.lit("- In words: "), bound, F.lit(", "), moved, F.lit(", coupling "), slope), F.when(odd != "", F.concat(F.lit("- Odd: "), odd)),
    )
    return d.select(U, "d", label().alias("label"), lines.alias("text"))


def gate_summary(last: DataFrame) -> DataFrame:
    """``risk, text`` from the hit counts of the gates."""
    risk = F.when(F.col("cr_hits") >= 3, "crisis").when(F.col("dr_hits") >= 2, "deep risk").when(F.col("ew_hits") >= 2, "early warning").otherwise("calm")
    return last.select(U, "d", risk.alias("risk"), F.format_string("EW %d/5, DR %d/4, CR %d/5: %s", "ew_hits", "dr_hits", "cr_hits", risk).alias("text"))


def transition_lines(changes: DataFrame) -> DataFrame:
    """``number, line`` of ``islands.transitions``: day, states, return and whether it hit."""
    hit = F.when(F.col("hit"), "hit").otherwise("miss")
    return changes.select(F.col("rank").cast("long").alias("number"), tsv(month_day("d"), F.concat(state_text("prev_state"), F.lit(" > "), state_text("state")), percent_points("return_pct"), hit).alias("line"))


def scored_lines(changes: DataFrame, scores: DataFrame, state: DataFrame) -> DataFrame:
    """``number, line``: the state of today first (0), then the changes, newest first, each with the last score and weight known on its day.

    ``scores`` has ``universe, d, score, w_trend``; ``state`` has ``universe, d, state``, a row a universe.
    """
    both = F.struct("score", "w_trend").alias("__s")
    day = lambda rows: as_of(rows, scores.select(U, "d", both), [U], "__s")
    known = F.concat(F.lit("score "), fixed(F.col("__s.score"), 3), F.lit(", trend "), fixed(F.col("__s.w_trend"), 2))
    now = day(state).select(F.lit(0).cast("long").alias("number"), tsv(month_day("d"), F.concat(F.lit("now "), state_text("state")), known).alias("line"))
    then = day(changes).select(F.col("rank").cast("long").alias("number"), tsv(month_day("d"), F.concat(state_text("prev_state"), F.lit(" > "), state_text("state")), percent_points("return_pct"), known).alias("line"))
    return now.unionByName(then)


def guarded(rows: DataFrame, stab: Stab = Stab()) -> DataFrame:
    """States with two overrides from the slope of the stability; ``rows`` has ``universe, idx, state, stability, ret5``.

    A fall that lasted ``lag_down`` rows opens a grace and, once that is over, a hazard: an on day within it becomes
    neutral.  A rise that lasted ``lag_up`` rows opens a lead: an off day within it becomes on if the base rose over five rows.
    """
    spans = {"up_lead": stab.lead_on, "grace": stab.down_grace, "hazard": stab.hazard}

    def fold(pdf: pd.DataFrame) -> dict:
        slope = ema_values(pdf["stability"], stab.fast) - ema_values(pdf["stability"], stab.slow)
        with np.errstate(invalid="ignore"):
            z = slope.to_numpy() / upper_mad_values(slope, stab.z_win)
            rise, fall = (z >= stab.z_up) & (slope >= stab.slope_min), (z <= -stab.z_down) & (slope <= -stab.slope_min)
        lasted = lambda flag, n: pd.Series(flag).astype(int).rolling(n).sum().eq(n).to_numpy()
        return opened(lasted(rise, stab.lag_up), lasted(fall, stab.lag_down), **spans)

    d = per_series(rows, fold, dict.fromkeys(("up_lead", "hazard"), "int"))
    s = F.col("state")
    state = F.when((s > 0) & (F.col("hazard") == 1), 0).when((s < 0) & (F.col("up_lead") == 1) & (F.coalesce("ret5", F.lit(0.0)) > 0), 1).otherwise(s)
    d = d.withColumn("guarded", state)
    return d.withColumn("guarded_executed", executed("guarded", series(U)))
