"""Fusion-Newgate: a trend state and a flow state mixed by a stress weight, then capped by gates.

All steps are window functions over one row a day, but for the rolling moments and ranks (passes over a series with
running sums and a sliding sorted window), the batched eigenvalue of the absorption ratio and the held cap (a fold over two flags).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.config import BASE, NEWGATE, SIGNALS, Newgate, pairs
from tidemark.functions.numeric import clamp, clamp01, hits, mean_of, ratio, sigmoid
from tidemark.operators import eigen, moments, order
from tidemark.operators.folds import held_cap, per_series
from tidemark.operators.islands import executed, latch
from tidemark.operators.rolling import frame, series, simple_return, so_far, with_rsi, with_slope
from tidemark.plans import records as R
from tidemark.plans.frame import triangle
from tidemark.plans.records import name

U = "universe"


def _w() -> WindowSpec:
    return series(U)


def flow_columns(panel: DataFrame, n: int = 63) -> DataFrame:
    """Flow, its running sum ``x``, gradient ``g``, one-sided sizes ``d_up, d_down`` and balance ``j``."""
    wide = R.with_returns(R.wide_aligned(panel))
    d = moments.with_moments(wide, {f"z_{name(s)}": moments.ZScore(f"r_{name(s)}", 252, first=251) for s in SIGNALS})
    up, down = mean_of("z_IWM", "z_SPY", "z_BTC_USD"), mean_of("z_TLT", "z_GLD")
    d = d.withColumn("flow", F.when(up.isNotNull() | down.isNotNull(), F.coalesce(up, F.lit(0.0)) - F.coalesce(down, F.lit(0.0))))
    d = d.withColumns({"x": F.when(F.col("flow").isNotNull(), F.sum("flow").over(so_far(_w()))), "g": F.coalesce(F.col("flow") - F.lag("flow").over(_w()), F.lit(0.0))})
    size = lambda c: F.sqrt(F.avg(F.pow(F.greatest(c, F.lit(0.0)), 2)).over(frame(_w(), n)))
    d = d.withColumns({"d_up": size(F.col("g")), "d_down": size(-F.col("g"))})
    d = with_slope(d, "x", (U,), n, 20, "mu")
    side = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    d = d.withColumns({"mu_up": side(F.col("mu")), "mu_down": side(-F.col("mu"))})
    return d.withColumn("j", (F.col("mu_up") - F.col("d_up") * side(F.col("g"))) - (F.col("mu_down") - F.col("d_down") * side(-F.col("g"))))


def with_absorption(d: DataFrame, n: int = 63) -> DataFrame:
    """``r``: share of the first component of the signals' correlations over ``n`` log returns."""
    cells = [R.cell(a, b) for a, b in pairs(SIGNALS)]
    return R.with_correlations(d, n, SIGNALS).withColumn("r", eigen.absorption(triangle(SIGNALS))).drop(*cells)


def stress(d: DataFrame, p: Newgate) -> DataFrame:
    """z-scores of the stress measures, their mix ``s`` and the weight of the trend state."""
    total = F.col("d_up") + F.col("d_down")
    d = d.withColumns({"chi": total / (F.col("mu_up") + F.col("mu_down") + 1e-8), "eta": F.abs(F.col("d_up") - F.col("d_down")) / (total + 1e-8), "dr": F.abs(F.col("r") - F.lag("r").over(_w())), "tilt": (F.col("d_down") - F.col("d_up")) / (total + 1e-8)})
    scored = {"z_chi": "chi", "z_eta": "eta", "z_r": "r", "z_dr": "dr", "z_tilt": "tilt", "z_j": "j", "__z_size": "__size"}
    d = moments.with_moments(d.withColumn("__size", F.abs("g")), {z: moments.ZScore(c, 252, first=251) for z, c in scored.items()})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = d.withColumn("s", p.a_chi * zero("z_chi") + p.b_eta * zero("z_eta") + p.c_r * zero("z_r") + p.d_dr * zero("z_dr"))
    shock = F.when((F.col("__z_size") > p.shock_z) & (F.col("g") < 0), 1 / 3).otherwise(1.0)
    return d.withColumns({"w_trend": clamp(sigmoid(F.col("s") - p.theta, p.kappa), p.w_min, p.w_max), "shock": shock}).drop("__size", "__z_size")


def trend(d: DataFrame, base: str = f"c_{BASE}") -> DataFrame:
    """``ta_score``: long mean and slope rank, strength ramp, calm rank; the mean of what is known."""
    d = moments.with_moments(with_rsi(d, base, (U,)), {"sma50": moments.Mean(base, 50), "__sma200": moments.Mean(base, 200), "__rv": moments.Deviation(f"r_{BASE}", 20, first=19)})
    d = with_slope(d.withColumn("__up", F.when(F.col(base) > F.col("__sma200"), 1.0).otherwise(0.0)), "sma50", (U,), 20, 10, "__slope")
    d = order.with_order(d, {"slope_rank": order.Rank("__slope"), "vol_rank": order.Rank("__rv")})
    score = mean_of(0.6 * F.col("__up") + 0.4 * F.coalesce("slope_rank", F.lit(0.0)), clamp01((F.col("rsi") - 30) / 40), 1 - F.col("vol_rank"))
    return d.withColumn("ta_score", score).drop("__rv", "__up", "__slope", "__sma200")


def _position(state: Column) -> Column:
    return F.when(state > 0, 1.0).when(state < 0, 0.0).otherwise(1 / 3)


def pnl(exposure: str | Column, ret: str) -> Column:
    return F.lag(exposure, 1, 0.0).over(_w()) * F.col(ret)


def mixed(d: DataFrame, p: Newgate) -> DataFrame:
    """Both latched states, their positions and the mix; quality measures of both."""
    d = d.withColumns({"ta_state": latch("ta_score", 0.60, 0.40, _w()), "flow_state": latch("z_j", p.on_thr, p.off_thr, _w()), "ret": simple_return(f"c_{BASE}", _w(), 1, 0.0)})
    d = d.withColumns({"pos_ta": _position(F.col("ta_state")), "pos_flow": _position(F.col("flow_state"))})
    d = d.withColumns({"pos_mix": clamp01(F.col("w_trend") * F.col("pos_ta") + (1 - F.col("w_trend")) * F.col("pos_flow")), "__pt": pnl("pos_ta", "ret"), "__pf": pnl("pos_flow", "ret"), "__j1": F.lag("j").over(_w())})
    quality = {f"{k}{c}": m(f"__p{c}") for c in "tf" for k, m in (("__m", lambda x: moments.Mean(x, 63, 30)), ("__s", lambda x: moments.Deviation(x, 63, 1, 30)))}
    d = moments.with_moments(d, quality | {"fqi": moments.Correlation("__j1", "ret", 63, 30)})
    d = d.withColumns({"tqi": ratio("__mt", "__st"), "ffqi": ratio("__mf", "__sf")}).drop(*quality)
    d = d.withColumn("spread", F.coalesce("tqi", F.lit(0.0)) - F.coalesce("ffqi", F.lit(0.0)))
    return d.withColumn("dt", F.col("spread") - F.coalesce(F.lag("spread", 10).over(_w()), F.lit(0.0))).drop("__pt", "__pf", "__j1")


def gates(d: DataFrame, p: Newgate) -> DataFrame:
    """Caps: early warning (2 of 5), deep risk (2 of 4), crisis (3 of 5, held)."""
    e, q, c = p.ew, p.dr, p.cr
    tilt, dr, chi, fqi = F.col("z_tilt"), F.col("z_dr"), F.col("z_chi"), F.col("fqi")
    ew = hits(tilt >= e["tilt"], dr >= e["dr"], chi >= e["chi"], fqi <= e["fqi"], F.col("dt") <= e["dt"])
    deep = hits(tilt >= q["tilt"], dr >= q["dr"], chi >= q["chi"], (fqi <= q["fqi"]) & (F.col("spread") <= 0))
    either = F.coalesce(tilt >= c["tilt"], F.lit(False)) | F.coalesce(F.col("z_eta") >= c["eta"], F.lit(False))
    crisis = hits(dr >= c["dr"], either, fqi <= c["fqi"], F.col("z_r") >= c["zr"], F.col("rsi") <= c["rsi"])
    d = d.withColumns({"ew_hits": ew, "dr_hits": deep, "cr_hits": crisis, "__calm": F.coalesce((chi < 0) & (dr < 0) & (tilt < 0), F.lit(False))})
    if p.cr_enabled:
        d = per_series(d, lambda x: {"cr_held": held_cap((x["cr_hits"] >= 3).to_numpy(), x["__calm"].to_numpy(), p.cr_hold)}, {"cr_held": "int"}, using=("cr_hits", "__calm"))
    else:
        d = d.withColumn("cr_held", F.lit(0))
    return d.drop("__calm")


def decided(d: DataFrame, p: Newgate) -> DataFrame:
    """``position``, ``state``, ``executed``.

    Where a preset asks, the off gate uses ``classic_state``, and the stability overlay the flow engine's ``flow_mm``,
    ``flow_j`` and ``flow_guard``; days that the flow engine does not know are not capped.
    """
    caps = [F.col("shock"), F.when(F.col("ew_hits") >= 2, p.g1).otherwise(1.0), F.when(F.col("dr_hits") >= 2, p.g2).otherwise(1.0), F.when(F.col("cr_held") > 0, p.g3).otherwise(1.0)]
    off = lambda c, cap: F.when(F.col(c) == -1, cap).otherwise(1.0)
    caps += [off("classic_state", p.off_cap)] if p.classic_off_gate else []
    caps += [off("flow_state", p.off_cap)] if p.flow_off_gate else []
    weak, broken = p.stab_mm
    holds = lambda c: F.coalesce(c, F.lit(False))
    if p.stab_off_cap is not None:
        caps.append(F.when(holds(F.col("flow_mm") >= broken) | holds(F.col("flow_j") <= p.stab_j_off), p.stab_off_cap).otherwise(1.0))
    if p.stab_soft_cap is not None:
        caps.append(F.when(holds((F.col("flow_mm") >= weak) & (F.col("flow_mm") < broken)) | holds(F.col("flow_guard") >= p.stab_guard), p.stab_soft_cap).otherwise(1.0))
    low, high = p.band
    d = d.withColumn("position", clamp01(F.col("pos_mix") * F.least(*caps)))
    v = F.col("position")
    d = d.withColumn("state", F.when(v >= high, 1).when(v <= low * 0.5, -1).otherwise(0))
    return d.withColumns({"executed": executed("state", _w()), "w_flow": 1 - F.col("w_trend")})


def newgate(panel: DataFrame, preset: str | Newgate = "aggressive_plus", extra: DataFrame | None = None) -> DataFrame:
    """The engine end to end; ``extra`` may bring ``classic_state, flow_mm, flow_j, flow_guard`` by ``universe, idx``."""
    p = NEWGATE[preset] if isinstance(preset, str) else preset
    return from_inputs(stress_inputs(panel, p.window), p, extra)


def stress_inputs(panel: DataFrame, window: int = 63) -> DataFrame:
    """What no preset changes but for its window: flow columns and the absorption ratio."""
    return with_absorption(flow_columns(panel, window), window)


def from_inputs(d: DataFrame, p: Newgate, extra: DataFrame | None = None) -> DataFrame:
    d = d if extra is None else d.join(extra, [U, "idx"], "left")
    return decided(gates(mixed(trend(stress(d, p)), p), p), p)


def diagnostics(done: DataFrame, p: Newgate) -> DataFrame:
    """The last row of each universe: gate label, hits, regime label and advice."""
    n = series(U).orderBy(F.desc("idx"))
    last = done.withColumn("__n", F.row_number().over(n)).filter("__n = 1").drop("__n")
    gate = F.when(F.col("cr_held") > 0, "CR").when(F.col("dr_hits") >= 2, "DR").when(F.col("ew_hits") >= 2, "EW").otherwise("none")
    label = F.when(F.col("state") > 0, "Risk-On").when(F.col("state") < 0, "Risk-Off").otherwise("Neutral")
    advice = F.when(gate != "none", "reduce").when(F.col("state") > 0, "hold").when(F.col("state") < 0, "stay out").otherwise("wait")
    return last.select(U, "d", gate.alias("gate"), "ew_hits", "dr_hits", "cr_hits", label.alias("label"), advice.alias("advice"), "position", "w_trend", ratio("mu_up", F.col("mu_up") + F.col("mu_down") + 1e-8).alias("flow_index"), (F.col("d_down") - F.col("d_up")).alias("downside"))


def concordance(done: DataFrame, n: int = 63) -> DataFrame:
    """How often both states agree in the last ``n`` rows; rows where both are neutral don't count."""
    last = done.withColumn("__n", F.row_number().over(series(U).orderBy(F.desc("idx")))).filter(F.col("__n") <= n)
    counts = (F.col("ta_state") != 0) | (F.col("flow_state") != 0)
    return last.groupBy(U).agg(F.avg(F.when(counts, (F.col("ta_state") == F.col("flow_state")).cast("double"))).alias("concordance"))
