"""ClassicFlux5: flux of the ten signal pairs with drift epochs, a correlation lock and a careful re-entry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import per_series
from tidemark.operators.islands import executed
from tidemark.operators.rolling import series
from tidemark.plans import frame
from tidemark.plans.records import cell

U = "universe"
INPUTS = ("down_all", "flux_norm", "diffusion", "kappa", "pcon", "mm_six", "v_six", "pair_corr", "spy_tlt", "bench20")


def inputs(panel: DataFrame, window: int = 30) -> DataFrame:
    """The daily frame with what the engine looks at; absorption and velocity are those of all six symbols."""
    w = series(U)
    d = frame.daily(panel, window, six=True).withColumns({"flux_norm": F.tanh(F.coalesce("flux_raw", F.lit(0.0)) / 0.25), "pcon": F.coalesce("pcon", F.lit(0.0)), "spy_tlt": F.col(cell("SPY", "TLT"))})
    step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    known = [F.col(f"z_{s}") for s in ("IWM", "SPY", "TLT", "GLD", "BTC_USD")]
    down = sum((F.when(z < 0, 1.0).otherwise(0.0) for z in known), F.lit(0.0))
    n = sum((z.isNotNull().cast("double") for z in known), F.lit(0.0))
    diffusion = F.col("flux_norm") - 0.5 * F.greatest(F.lit(0.0), step("mm_six")) - 0.15 * F.greatest(F.lit(0.0), -step("flux_norm"))
    d = d.withColumns({"down_all": F.coalesce(F.try_divide(down, n), F.lit(0.0)), "diffusion": diffusion})
    kappa = F.abs("diffusion") / (F.abs("diffusion") + F.abs(F.coalesce("v_six", F.lit(0.0))) + 1e-6)
    score = 0.70 * F.greatest(F.lit(0.0), F.coalesce("pair_corr", F.lit(0.0))) + 0.30 * F.col("safe_negative")
    return d.withColumns({"kappa": kappa, "flux_score": score})


def fold(pdf: pd.DataFrame, j_on: float = 0.10, j_off: float = -0.08, k_on: float = 0.60, pcon_on: float = 0.55, pcon_off: float = 0.40, v_on: float = 0.05, v_off: float = -0.05, mm_hi: float = 0.90, mm_off: float = 0.96, down_all: float = 0.60, lock_days: float = 5, drift_days: float = 3, drift_cool: float = 2, off_days: float = 3) -> list[int]:
    """The sticky state of each day, in order: drift epoch, lock countdown, days off, a re-entry armed once after a drift."""
    x = {c: pdf[c].to_numpy(float) for c in INPUTS}
    mm, v = np.nan_to_num(x["mm_six"]), np.nan_to_num(x["v_six"])
    with np.errstate(invalid="ignore"):
        drifts = ((x["down_all"] >= down_all) & (x["flux_norm"] <= 0)) | ((mm >= mm_hi) & ~(x["bench20"] > 0))
        locks = (x["pair_corr"] >= 0.50) & (x["spy_tlt"] >= -0.10) & (mm >= mm_hi)
        likes = (x["kappa"] >= k_on) & (x["pcon"] >= pcon_on) & (mm < mm_off) & (v >= v_on)
        fears = ((v <= v_off) & (abs(v) >= 0.05)) | ((x["diffusion"] <= j_off) & (x["kappa"] < 0.55)) | (x["pcon"] <= pcon_off) | (mm >= mm_off) | ((mm >= mm_hi) & (v <= 0))
    state, drift_run, calm_run, epoch, lock, on_run, days_off, armed = 0, 0, 0, False, 0, 0, 0, False
    out = []
    for drift, locked, like, fear, diffusion in zip(drifts.tolist(), locks.tolist(), likes.tolist(), fears.tolist(), x["diffusion"].tolist()):
        drift_run, calm_run = (drift_run + 1, 0) if drift else (0, calm_run + 1)
        epoch = (epoch or drift_run >= drift_days) and calm_run < drift_cool
        lock = max((lock_days if locked else lock) - 1, 0)
        armed = armed or (not epoch and calm_run == 1)
        on = like and not epoch and not lock and days_off >= off_days and diffusion >= j_on + 0.05 * armed
        on_run = on_run + 1 if on else 0
        if epoch or ((fear or lock > 0) and state >= 0):
            state = -1
        elif state < 1 and on_run >= 2:
            state = 1
        days_off = days_off + 1 if state == -1 else 0
        armed = armed and state != 1
        out.append(state)
    return out


def flux5(rows: DataFrame, **parameters: float) -> DataFrame:
    """``inputs`` with ``state`` and ``executed``."""
    d = per_series(rows, lambda p: {"state": fold(p, **parameters)}, {"state": "int"})
    return d.withColumn("executed", executed("state", series(U)))
