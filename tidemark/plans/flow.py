"""Flow regime: how momentum moves between risk and safe assets along their correlations.

``columns`` makes every input as plain columns; ``fit`` gives each universe its thresholds (it looks at all its days);
``conditions`` turns both into boolean columns and streaks; only the last sticky decision is a fold over
a few flags a day.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BASE, CLUSTER, SIGNALS, Flow
from tidemark.functions.numeric import clamp01, finite, mean_of, normalize_range, sigmoid, weighted_mean_of
from tidemark.operators import quantiles
from tidemark.operators.folds import ema_values, mad_values, per_series
from tidemark.operators.islands import executed, with_streak
from tidemark.operators.rolling import series, so_far, z_momentum
from tidemark.plans import frame as daily_frame
from tidemark.plans import records as R
from tidemark.plans.records import name
from tidemark.sources import shared

U = "universe"
RISK = tuple(s for s in SIGNALS if CLUSTER[s] == "risk")


def _z(s: str) -> Column:
    return F.col(f"z_{name(s)}")


def momenta(panel: DataFrame) -> DataFrame:
    """One row a day: closes, simple returns ``r_*`` and z-momentum ``z_*`` of every signal."""
    w = series(U)
    wide = R.with_returns(R.wide_aligned(panel), kind="simple")
    return wide.withColumns({f"z_{name(s)}": z_momentum(f"c_{name(s)}", w, f"r_{name(s)}") for s in SIGNALS})


def pair_flux(corr: DataFrame, momentum: DataFrame) -> DataFrame:
    """Per day the weighted flux of the pairs: ``flux_raw, intensity, apdf, pcon, rb``; weights are |c|^1.5."""
    z = F.create_map(*(x for s in SIGNALS for x in (F.lit(s), F.coalesce(_z(s), F.lit(0.0)))))
    w = series(U, "s1", "s2")
    rows = corr.filter(F.col("s1").isin(*SIGNALS) & F.col("s2").isin(*SIGNALS)).withColumn("dc", F.col("corr") - F.lag("corr").over(w))
    rows = rows.join(momentum.select(U, "idx", z.alias("z")), [U, "idx"]).withColumns({"w": F.pow(F.abs("corr"), 1.5), "a": F.element_at("z", F.col("s1")), "b": F.element_at("z", F.col("s2"))})
    kind, a, b, weight = F.col("kind"), F.col("a"), F.col("b"), F.col("w")
    push = F.when(kind == "cross", a - b).when(kind == "risk", (a + b) / 2).otherwise(-(a + b) / 2)
    agree = F.when(kind == "cross", a > b).when(kind == "risk", (a > 0) & (b > 0)).otherwise((a <= 0) & (b <= 0)).cast("double")
    mean = lambda when, x: F.try_divide(F.sum(F.when(when, weight * x)), F.sum(F.when(when, weight)))
    moved = (kind == "risk") & F.col("dc").isNotNull()
    g = rows.groupBy(U, "idx", "d").agg(
        mean(kind == "cross", a - b).alias("flux_raw"), mean(kind == "cross", F.abs(a - b)).alias("intensity"),
        mean(F.lit(True), push).alias("apdf"), mean(F.lit(True), agree).alias("pcon"), mean(moved, F.col("dc") * F.signum(a + b)).alias("rb"),
    )
    return g.withColumns({"apdf": F.tanh(F.coalesce("apdf", F.lit(0.0)) / 0.25), "rb": F.tanh(F.coalesce("rb", F.lit(0.0)) / 0.25), "pcon": clamp01("pcon")})


def day_columns(d: DataFrame) -> DataFrame:
    """What follows from a day's row of ``frame.inputs`` alone."""
    zs, risk = [_z(s) for s in SIGNALS], [_z(s) for s in RISK]
    share = lambda cols, test: F.try_divide(sum((F.coalesce(test(c), F.lit(False)).cast("double") for c in cols), F.lit(0.0)), sum((c.isNotNull().cast("double") for c in cols), F.lit(0.0)))
    return d.withColumns({
        "down_all": share(zs, lambda c: c < 0), "combo": mean_of(*risk), "breadth": share(risk, lambda c: c > 0), "ret": F.col(f"s_{BASE}"),
        "risk3": mean_of(*(f"ret3_{name(s)}" for s in RISK)),
        "day0": F.coalesce(F.col(f"s_{BASE}") > 0, F.lit(False)) | F.coalesce(F.col("s_IWM") > 0, F.lit(False)),
        "day0_both": F.coalesce(F.col(f"s_{BASE}") > 0, F.lit(False)) & F.coalesce(F.col("s_IWM") > 0, F.lit(False)),
    })


def guarded_columns(d: DataFrame) -> DataFrame:
    """``guard, score, far`` of rows that have the means, the flux ``j`` and ``day_columns``."""
    guard = 0.4 * normalize_range("mm", 0.85, 0.97) + 0.2 * normalize_range("safe_negative", 0.35, 0.60) + 0.2 * normalize_range(F.greatest(F.lit(0.0), -F.col("delta")), 0.015, 0.05) + 0.2 * F.coalesce(sigmoid("frob_z", 0.85), F.lit(1.0))
    d = d.withColumn("guard", guard)
    score = weighted_mean_of(((1 + F.col("j")) / 2, 0.5), (clamp01((F.col("combo") + 1) / 2), 0.2), (clamp01("breadth"), 0.2), (clamp01(1 - F.col("guard")), 0.1))
    return d.withColumns({"score": score, "far": F.when(F.col("mm") > 0, F.abs("j") / (F.col("mm") + 1e-9))})


def columns(panel: DataFrame, window: int = 30) -> DataFrame:
    """Every input of the engine, one row a day: the daily frame and expressions of its rows."""
    w = series(U)
    d = daily_frame.daily(panel, window)
    d = d.withColumn("j", F.tanh(F.coalesce("flux_raw", F.lit(0.0)) / 0.25) * F.col("damp"))
    d = guarded_columns(day_columns(d.withColumns({"flux_slope": F.col("j") - F.lag("j").over(w), "mm_trend": F.col("mm") - F.lag("mm").over(w)})))
    return d.withColumn("diffusion", F.col("j") - 0.5 * F.greatest(F.lit(0.0), F.coalesce("mm_trend", F.lit(0.0))) - 0.15 * F.greatest(F.lit(0.0), -F.coalesce("flux_slope", F.lit(0.0))))


def fit(cols: DataFrame, p: Flow = Flow()) -> DataFrame:
    """``universe, on, off, score_on, score_off``: thresholds of the flux and of the score, a row a universe.

    They lie at quantiles of the universe's whole history (on and off of the flux, quartiles of the score), but no nearer than
    the fixed ones; universes with fewer than ``quantile_rows`` values, and the classic variant, take the fixed ones.  The
    table can be kept and joined to later days by ``with_thresholds``.
    """
    fixed = {"on": p.j_on, "off": p.j_off, "score_on": p.score_on, "score_off": p.score_off}
    out = cols.select(U).distinct()
    if p.variant != "classic":
        for x, shares, names in (("j", [p.q_on, p.q_off], ("on", "off")), ("score", [0.75, 0.25], ("score_on", "score_off"))):
            q = quantiles.exact(cols, x, shares, (U,)).filter(F.col("n") >= p.quantile_rows)
            out = out.join(q.select(U, F.greatest(F.lit(fixed[names[0]]), F.get("q", F.lit(0))).alias(names[0]), F.least(F.lit(fixed[names[1]]), F.get("q", F.lit(1))).alias(names[1])), U, "left")
    return out.select(U, *(F.coalesce(F.col(c), F.lit(x)).alias(c) if c in out.columns else F.lit(x).alias(c) for c, x in fixed.items()))


def with_thresholds(cols: DataFrame, fitted: DataFrame | tuple[float, float], p: Flow = Flow()) -> DataFrame:
    """``cols`` with ``on, off, score_on, score_off`` of its universe; the fixed ones where ``fitted`` does not know it, a pair for all."""
    if not isinstance(fitted, DataFrame):
        return cols.withColumns({"on": F.lit(float(fitted[0])), "off": F.lit(float(fitted[1])), "score_on": F.lit(p.score_on), "score_off": F.lit(p.score_off)})
    fixed = {"on": p.j_on, "off": p.j_off, "score_on": p.score_on, "score_off": p.score_off}
    return cols.join(fitted.select(U, *fixed), U, "left").withColumns({c: F.coalesce(F.col(c), F.lit(x)) for c, x in fixed.items()})


def _of_one(cols: DataFrame, p: Flow) -> dict:
    """The fit of a table of one universe."""
    rows = fit(cols if U in cols.columns else cols.withColumn(U, F.lit("core")).withColumns({c: F.lit(None).cast("double") for c in ("j", "score") if c not in cols.columns}), p).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("several universes: use fit")
    return rows[0].asDict() if rows else {"on": p.j_on, "off": p.j_off, "score_on": p.score_on, "score_off": p.score_off}


def thresholds(cols: DataFrame, p: Flow = Flow()) -> tuple[float, float]:
    """(on, off) of the flux of a table of one universe, as plain numbers to freeze."""
    f = _of_one(cols, p)
    return f["on"], f["off"]


def score_thresholds(cols: DataFrame, p: Flow = Flow()) -> tuple[float, float]:
    """(on, off) of the score of a table of one universe."""
    f = _of_one(cols, p)
    return f["score_on"], f["score_off"]


def _or(value: Column, missing: bool) -> Column:
    return F.coalesce(value, F.lit(missing))


def with_stability_trend(cols: DataFrame, p: Flow) -> DataFrame:
    """``s_slope`` (fast less slow mean of the stability) and ``s_z``, its size in robust deviations: one pass a series.

    Columns ``fast, slow, z_win`` of a search stand before the parameters.
    """
    asked = {k: k in cols.columns for k in ("fast", "slow", "z_win")}
    fixed = {k: getattr(p.stab, k) for k in asked}

    def fold(pdf: pd.DataFrame) -> dict:
        fast, slow, z_win = (int(pdf[k].iloc[0]) if held else fixed[k] for k, held in asked.items())
        slope = ema_values(pdf["stability"], fast) - ema_values(pdf["stability"], slow)
        return {"s_slope": slope, "s_z": slope / mad_values(slope, z_win)}

    used = ("stability", *(k for k in asked if asked[k]))
    return _nulls(per_series(cols, fold, {"s_slope": "double", "s_z": "double"}, using=used), "s_slope", "s_z")


def with_ratio_timing(cols: DataFrame, p: Flow) -> DataFrame:
    """EXP: the smoothed ratio of diffusion to drift, its fast less slow mean ``st``, the step and its deviation."""
    lam, win = p.exp.lam, p.exp.win

    def fold(pdf: pd.DataFrame) -> dict:
        raw = pdf["diffusion"] / (lam * pdf["v_pc1"].fillna(0).abs() + 1e-6)
        ratio = raw.ewm(alpha=0.5, adjust=False, ignore_na=True).mean()
        st = ema_values(ratio.fillna(0), 3) - ema_values(ratio.fillna(0), 10)
        return {"ratio": ratio, "st": st, "d_st": st.diff(), "st_before": st.shift(), "st_sigma": mad_values(st, win)}

    out = dict.fromkeys(("ratio", "st", "d_st", "st_before", "st_sigma"), "double")
    return _nulls(per_series(cols, fold, out, using=("diffusion", "v_pc1")), *out)


def _nulls(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: finite(c) for c in names})


def signals(d: DataFrame, on: float | Column, off: float | Column, p: Flow = Flow()) -> DataFrame:
    """What a day's row says alone: ``raw_on, confirm`` and the flags ``__off, __guard, __need, __drift`` (and those of the
    stability overlay) from which streaks and the state follow.  No neighbours are looked at, so it runs on streams too.
    """
    mm, j, diff, pcon, combo, guard, v = (F.coalesce(c, F.lit(x)) if x is not None else F.col(c) for c, x in (("mm", 0.0), ("j", 0.0), ("diffusion", 0.0), ("pcon", None), ("combo", None), ("guard", 1.0), ("v_pc1", 0.0)))
    breadth = F.coalesce("breadth", F.lit(0.0))
    kappa = F.abs(diff) / (F.abs(diff) + p.kappa_lambda * F.abs(v) + 1e-6)
    high = on + F.when(mm >= 0.94, 0.05).when(mm >= 0.90, 0.03).otherwise(0.0)
    bear = (mm >= p.mm_hi) & _or(F.col("bench10") <= 0, True)
    drift = (_or(F.col("down_all") >= 0.60, False) & (j <= 0)) | ((mm >= p.mm_hi) & _or(F.col("bench20") <= 0, True))
    d = d.withColumns({"kappa": kappa, "__drift": drift})
    booster, exp_ok, exp_off = F.lit(False), F.lit(True), F.lit(False)
    if p.variant == "exp":
        sigma = F.col("st_sigma")
        x = p.exp
        scale = F.when(mm >= p.mm_hi, x.high_scale).otherwise(1.0)
        day0 = F.when(mm >= p.mm_hi, F.col("day0_both")).otherwise(F.col("day0")) if x.both_when_high else F.col("day0")
        booster = ~bear & _or(F.col("pair_corr") >= 0.50, False) & ((breadth >= 0.55) | _or(combo >= 0.05, False))
        timed = _or((F.col("st") > scale * x.on_k * F.coalesce(sigma, F.lit(0.0))) & (F.col("d_st") > 0) & (F.col("ratio") > 0), False) | sigma.isNull()
        cross = _or((F.col("st_before") <= 0) & (F.col("st") > 0) & (F.col("d_st") > 0), False)
        wide = F.when(mm >= p.mm_hi, breadth >= x.breadth).otherwise(True)
        exp_ok = (_or(F.col("ratio") >= x.r_on, True) & day0 & wide & timed) | (day0 & (cross | booster))
        exp_off = _or(F.col("ratio") <= x.r_off, False) | _or((F.col("st") < -scale * x.off_k * F.coalesce(sigma, F.lit(0.0))) & (F.col("d_st") < 0) & (F.col("ratio") < 0), False)
    agree = _or(pcon >= p.pcon_on, True) | (diff >= high + 0.07) | booster
    strict = ~bear | ((diff >= high + 0.05) & _or(pcon >= 0.65, True) & _or(F.col("apdf") >= 0, True) & _or(combo >= 0.10, True))
    main = (diff >= high) & agree & _or(F.col("apdf") >= -0.05, True) & strict & (guard < 0.95) & (mm < p.mm_off) & (breadth >= 0.30) & exp_ok
    alt = ~bear & _or(F.col("rb") >= 0.06, False) & _or(combo >= 0.10, False) & (guard < 0.90)
    strong = (diff >= high + 0.03) & (kappa >= 0.60) & _or(pcon >= 0.65, True) & (v >= 0.05) & (guard < 0.95) & (mm < p.mm_off)
    raw_on = (main | alt | strong) & ~drift & ~(_or(F.col("risk3") <= 0, False) & (mm >= p.mm_hi))
    broken = j <= off
    guard_only = ((guard >= 0.98) | (mm >= p.mm_off)) & ~broken
    support = (j >= on - 0.03) & (breadth >= 0.25) & _or(combo >= 0, True)
    by_rel = (v <= -0.05) | ((diff <= off) & (kappa < 0.55)) | exp_off
    off_now = by_rel | broken | (_or(pcon <= p.pcon_off, False) & (mm >= 0.92)) | drift
    tense = (mm >= p.mm_hi) | (F.coalesce("mm_trend", F.lit(0.0)) > 0.005) | (F.coalesce("frob_z", F.lit(0.0)) >= 1.5)
    easy = (F.coalesce("flux_slope", F.lit(0.0)) > 0) & (F.coalesce("mm_trend", F.lit(0.0)) <= 0)
    confirm = F.when(strong, 1).when(tense, 3).when(_or(pcon >= 0.68, False) | easy, 1).otherwise(2)
    if p.variant == "exp":
        confirm = F.when(_or(F.col("st") >= x.strong_k * x.on_k * F.col("st_sigma"), False), 1).when(cross, F.greatest(F.lit(1), confirm - 1)).otherwise(confirm)
    flags = {"raw_on": raw_on, "confirm": confirm, "__off": off_now, "__guard": guard_only, "__need": F.when((mm >= 0.92) & support, 3).otherwise(2)}
    if p.variant == "stab":
        s, slope, z = p.stab, F.col("s_slope"), F.col("s_z")
        flags |= {
            "__down": _or(slope < -s.slope_min, False), "__up": _or((z >= s.z_up) & (slope >= s.slope_min), False), "__up_need": F.lit(s.up_confirm_off),
            "__flat": F.col("stability").between(s.neutral_lo, s.neutral_hi) & _or(F.abs(slope) < 0.005, False) & (F.abs("j") < 0.03), "__rising": _or(slope > 0, False), "__plunge": _or((z <= -s.z_down) & (slope < 0), False),
        }
    return d.withColumns(flags)


def timed(cols: DataFrame, p: Flow = Flow()) -> DataFrame:
    """``cols`` with the columns of the variant's own timing; no threshold is looked at."""
    return with_stability_trend(cols, p) if p.variant == "stab" else with_ratio_timing(cols, p) if p.variant == "exp" else cols


def conditions(cols: DataFrame, on: float | Column, off: float | Column, p: Flow = Flow(), made: bool = False) -> DataFrame:
    """``raw_on, raw_off, confirm, drift, need_off, flat`` of every day; ``on`` and ``off`` are numbers or the day's own thresholds.

    ``made``: ``cols`` come from ``timed``.
    """
    d = with_streak(signals(cols if made else timed(cols, p), on, off, p), F.col("__guard"), "__guard_run")
    raw_off = F.col("__off") | (F.col("__guard") & (F.col("__guard_run") >= F.col("__need")))
    d = with_streak(with_streak(d, F.col("__drift"), "__drift_run"), ~F.col("__drift"), "__calm_run")
    epoch = F.when(F.col("__drift_run") >= p.drift_days, 1).when(F.col("__calm_run") >= p.drift_cool, 0)
    d = d.withColumns({"raw_off": raw_off, "drift": F.coalesce(F.last(epoch, ignorenulls=True).over(so_far(series(U))), F.lit(0)) == 1})
    if p.variant == "stab":
        s = p.stab
        d = with_streak(with_streak(with_streak(d, F.col("__down"), "__down_run"), F.col("__up"), "__up_run"), F.col("__flat"), "__flat_run")
        later = F.when(F.col("__plunge"), True).when(F.col("__rising"), False).otherwise(F.col("raw_off") | (F.col("__down_run") >= s.lag_down))
        return d.withColumns({"raw_off": later, "need_off": F.when(F.col("__up_run") >= s.lag_up, F.col("__up_need")).otherwise(1), "flat": F.col("__flat_run") >= 2})
    return d.withColumns({"need_off": F.lit(1), "flat": F.lit(False)})


def decide(raw_on, raw_off, confirm, need_off, drift, flat, lean=None) -> list[int]:
    """The sticky state of each day from its flags.  ``lean`` decides an undecided neutral day."""
    out, state, on_run, off_run = [], 0, 0, 0
    for i in range(len(raw_on)):
        on_run = on_run + 1 if raw_on[i] else 0
        off_run = off_run + 1 if raw_off[i] else 0
        if state == 1:
            state = -1 if raw_off[i] and off_run >= need_off[i] else 1
        elif state == -1:
            state = 1 if on_run >= confirm[i] else -1
        else:
            state = -1 if off_run else 1 if on_run >= confirm[i] else int(lean[i]) if lean is not None else 0
        state = 0 if flat[i] else -1 if drift[i] else state
        out.append(state)
    return out


def states(flagged: DataFrame, p: Flow = Flow()) -> DataFrame:
    """``flagged`` with ``state``, ``executed`` and ``fragile``."""

    def fold(pdf: pd.DataFrame) -> dict:
        lean = pdf["j"].fillna(0).apply(lambda x: (x > 0) - (x < 0)) if p.variant == "exp" else None
        return {"state": decide(*(pdf[c].tolist() for c in ("raw_on", "raw_off", "confirm", "need_off", "drift", "flat")), lean)}

    d = per_series(flagged, fold, {"state": "int"}, using=("raw_on", "raw_off", "confirm", "need_off", "drift", "flat", *(["j"] if p.variant == "exp" else [])))
    return d.withColumns({"executed": executed("state", series(U)), "fragile": fragile("state", "guard")})


def fragile(state: str, guard: str) -> Column:
    """A day that is not off while its guard (1 where unknown) is high."""
    return (F.col(state) >= 0) & (F.coalesce(guard, F.lit(1.0)) >= 0.88)


def decided(cols: DataFrame, p: Flow = Flow(), at: DataFrame | tuple[float, float] | None = None) -> DataFrame:
    """``states`` of ``columns``; without ``at`` the thresholds of each universe are fitted on it."""
    flagged = conditions(with_thresholds(cols, fit(cols, p) if at is None else at, p), F.col("on"), F.col("off"), p)
    return states(flagged.select(*(c for c in flagged.columns if not c.startswith("__"))), p)


def flow(panel: DataFrame, window: int = 30, p: Flow = Flow(), at: DataFrame | tuple[float, float] | None = None) -> DataFrame:
    """The engine end to end.  ``at`` freezes the thresholds: a table of ``fit``, or (on, off) for all; without it they are fitted on this panel.

    The daily columns are written once: the fit and the decision both read them.
    """
    return decided(shared.settled(columns(panel, window), "flow"), p, at)


def plain_state(cols: DataFrame, on: float | Column, off: float | Column, score_on: float | Column = 0.60, score_off: float | Column = 0.40) -> DataFrame:
    """The rule without memory: score, flux, breadth and guard; thresholds as ``conditions`` has them."""
    s, j, c, g = F.col("score"), F.col("j"), F.coalesce("combo", F.lit(0.0)), F.coalesce("guard", F.lit(1.0))
    up = (s >= score_on) & (j >= on) & (c > -0.005) & (F.coalesce("breadth", F.lit(0.0)) >= 0.5) & (g < 0.90)
    down = (s <= score_off) | (j <= off) | (c <= -0.03) | (F.col("mm") >= 0.96) | (g >= 1)
    state = F.when(up, 1).when(down, -1).otherwise(0)
    weak = F.when(up, g >= 0.55).when(~down, (g >= 0.80) & (j >= 0) & (c >= -0.02)).otherwise(False)
    return cols.withColumns({"state": state, "fragile": F.coalesce(weak, F.lit(False))})
