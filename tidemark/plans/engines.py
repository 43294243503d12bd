"""Rule engines on daily records: Classic, Enhanced, fusion of two engines, and their execution shift.

A state is 1 (Risk-On), 0 (Neutral) or -1 (Risk-Off).
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CLUSTER, SIGNALS, Thresholds
from tidemark.functions.numeric import clamp01, mean_of, normalize_range, softmax2
from tidemark.operators import quantiles
from tidemark.operators.islands import executed
from tidemark.operators.rolling import series, with_skill
from tidemark.plans.records import name

U = "universe"
RISK = tuple(s for s in SIGNALS if CLUSTER[s] == "risk")


def case_state(on: Column, off: Column, later_on: Column | None = None) -> Column:
    state = F.when(on, 1).when(off, -1)
    return (state if later_on is None else state.when(later_on, 1)).otherwise(0)


def classic(records: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``score`` and ``state`` from the pair IWM-BTC and the hedge sub-index."""
    c = F.col("pair_corr")
    scored = records.withColumn("score", clamp01(0.70 * F.greatest(F.lit(0.0), c) + 0.30 * F.col("safe_negative")))
    s = F.col("score")
    return scored.withColumn("state", case_state(c >= t.pair_on, (c <= t.pair_off) | (s <= t.score_off), (s >= t.score_on) & (c >= t.pair_min)))


def fit(records: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """``universe`` and the fields of ``Thresholds``: at quantiles of the universe's pair correlation and score, a row a universe.

    This looks at all days, so it is a fit of its own and never part of an engine; the table can be kept for later days.
    """
    scored = classic(records)
    c, s = (quantiles.exact(scored, x, [low, high], (U,)).select(U, F.get("q", F.lit(0)).alias(f"{x}_low"), F.get("q", F.lit(1)).alias(f"{x}_high")) for x in ("pair_corr", "score"))
    q = c.join(s, U)
    middle = (F.col("pair_corr_low") + F.col("pair_corr_high")) / 2
    return q.select(U, F.col("pair_corr_high").alias("pair_on"), F.col("pair_corr_low").alias("pair_off"), F.col("score_high").alias("score_on"), F.col("score_low").alias("score_off"), middle.alias("pair_min"))


def classic_fitted(records: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """``classic`` with the thresholds of the day's universe, those of ``fit`` if none are given; the fixed ones where it is unknown."""
    names = [f.name for f in fields(Thresholds)]
    found = (fit(records) if fitted is None else fitted).select(U, *(F.col(n).alias(f"__{n}") for n in names))
    met = records.join(found, U, "left").withColumns({f"__{n}": F.coalesce(f"__{n}", F.lit(getattr(Thresholds(), n))) for n in names})
    return classic(met, Thresholds(**{n: F.col(f"__{n}") for n in names})).drop(*(f"__{n}" for n in names))


def fitted(records: DataFrame, low: float = 0.3, high: float = 0.7) -> Thresholds:
    """The fit of a table of one universe as plain numbers to freeze; the fixed ones without records."""
    rows = fit(records, low, high).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("several universes: use fit")
    return Thresholds(**{f.name: rows[0][f.name] for f in fields(Thresholds)}) if rows else Thresholds()


def enhanced(rec: DataFrame) -> DataFrame:
    """Classic with momentum, breadth and an absorption guard, on ``frame.daily``; ``fragile`` marks a state near its limits."""
    five = [F.col(f"ret5_{name(s)}") for s in RISK]
    up = sum((F.when(r > 0, 1.0).otherwise(0.0) for r in five[1:]), F.when(five[0] > 0, 1.0).otherwise(0.0))
    known = sum((r.isNotNull().cast("double") for r in five[1:]), five[0].isNotNull().cast("double"))
    d = classic(rec).withColumnRenamed("state", "classic_state").withColumns({"combo": mean_of(*(f"ret10_{name(s)}" for s in ("IWM", "BTC-USD"))), "breadth": F.try_divide(up, known)})
    c, mm, safe, combo = F.col("pair_corr"), F.col("mm"), F.col("safe_negative"), F.col("combo")
    d = d.withColumns({
        "mom": clamp01((F.coalesce(combo, F.lit(0.0)) + 0.015) / 0.06),
        "guard": 0.5 * normalize_range(mm, 0.85, 0.97) + 0.2 * normalize_range(safe, 0.35, 0.60) + 0.3 * normalize_range(F.greatest(F.lit(0.0), -F.col("delta")), 0.015, 0.05),
    })
    blend = 0.35 * clamp01((c - 0.15) / 0.55) + 0.40 * F.col("mom") + 0.15 * F.coalesce(clamp01("breadth"), F.lit(0.0)) + 0.10 * (1 - normalize_range(mm, 0.78, 0.94))
    d = d.withColumn("blend", blend)
    b, g, move = F.col("blend"), F.col("guard"), F.coalesce(combo, F.lit(0.0))
    on = (b >= 0.60) & (c >= 0.33) & (F.col("mom") >= 0.35) & (g < 0.9) & (move > -0.005)
    off = (b <= 0.30) | (move <= -0.03) | (c <= 0) | (mm >= 0.96) | ((safe >= 0.65) & (move <= 0)) | (g >= 1)
    d = d.withColumn("state", case_state(on, off))
    return d.withColumn("fragile", F.when(F.col("state") == 1, g >= 0.55).when(F.col("state") == 0, (g >= 0.8) & (c >= 0.3) & (move >= -0.02)).otherwise(False))


def fusion(two: DataFrame, win: int = 40, lam: float = 0.5, tau: float = 4.0, floor: float = 0.10, on: float = 0.20, off: float = -0.20, mm_fragile: float = 0.88, mm_off: float = 0.96) -> DataFrame:
    """Mix of the states ``state_c`` and ``state_f`` by how well each, a day old, predicted ``ret``.

    ``two`` has ``universe, idx, d, state_c, state_f, ret, mm``.
    """
    w = series(U)
    d = two.withColumns({"p_c": executed("state_c", w), "p_f": executed("state_f", w), "r": F.coalesce("ret", F.lit(0.0))})
    d = with_skill(d, {"_c": ("p_c", "r"), "_f": ("p_f", "r")}, win)
    skill = lambda k: lam * (F.col(f"hit_{k}") - 0.5) + (1 - lam) * F.col(f"ic_{k}")
    d = d.withColumns({"skill_c": skill("c"), "skill_f": skill("f")}).drop("hit_c", "hit_f", "ic_c", "ic_f")
    w_c, w_f = softmax2("skill_c", "skill_f", tau, floor)
    d = d.withColumns({"w_c": w_c, "w_f": w_f})
    d = d.withColumn("fused", F.col("w_c") * F.col("state_c") + F.col("w_f") * F.col("state_f"))
    v, mm = F.col("fused"), F.coalesce("mm", F.lit(0.0))
    state = F.when(mm >= mm_off, -1).when((mm >= mm_fragile) & (v > 0), 0).when(v >= on, 1).when(v <= off, -1).otherwise(0)
    d = d.withColumns({"state": state, "score": clamp01((v + 1) / 2), "fragile": mm >= mm_fragile})
    return d.withColumn("executed", executed("state", w))
