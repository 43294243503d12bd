"""The flow engine on a stream of days: what the batch engine folds over a whole history is carried between micro-batches.

Days come as rows of ``frame.inputs`` with ``flow.day_columns``: a bounded number of rows before gives these, so they are made by
``recomputed`` (``streaming/panel.py``) or any batch job.  Two stateful operators follow, keyed by universe:

* ``Means``: the exponential means (stability, squared gains and losses, the overlay's fast and slow mean or the ratio of the exp
  variant) as value state, and the values that rolling deviations look back to as list state;
* ``Decision``: streaks, the drift epoch and the sticky state as value state.

Between them the same column expressions as in batch (``flow.signals``) run.  Thresholds are frozen: a table of ``flow.fit``.
With ``forget_after`` a universe without a new day for so long loses its state by a timer.

Days of a universe must come in order; a day at or before the last one is passed over, so a batch that is read twice
changes nothing.  Missing values are NULL in, and NULL out where batch has NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isnan, nan

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import Flow
from tidemark.functions.numeric import finite
from tidemark.operators.order import SortedWindow
from tidemark.plans import flow, frame
from tidemark.plans.frame import DAMPED
from tidemark.plans.records import name

U = "universe"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEANS = ("smoothed", "delta", "bear_ratio", "frob_z", "j", "flux_slope", "mm_trend", "diffusion")
TRENDS = {"stab": ("s_slope", "s_z"), "exp": ("ratio", "st", "d_st", "st_before", "st_sigma"), "classic": ()}


class Ema:
    """An exponential mean of the values so far; missing ones are passed over."""

    def __init__(self, values: list[float], at: int, alpha: float):
        self.values, self.at, self.alpha = values, at, alpha

    def push(self, x: float) -> float:
        held = self.values[self.at]
        if not isnan(x):
            held = x if isnan(held) else (1 - self.alpha) * held + self.alpha * x
            self.values[self.at] = held
        return held


class Memory:
    """What the means of one universe remember: numbers, and the last values of two windows."""

    SIZE = 16

    def __init__(self, p: Flow, numbers: list[float] | None = None, frob: list[float] | None = None, trend: list[float] | None = None, frob_rows: int = 63, span: int = 60):
        self.p, self.numbers = p, list(numbers) if numbers else [nan] * self.SIZE
        ema = lambda at, alpha: Ema(self.numbers, at, alpha)
        of = lambda n: 2 / (n + 1)
        self.e3, self.e10 = ema(0, of(3)), ema(1, of(10))
        self.sides = [(ema(2 + 2 * k, of(span)), ema(3 + 2 * k, of(span))) for k in range(len(DAMPED))]
        self.a, self.b, self.c = (ema(8, of(p.stab.fast)), ema(9, of(p.stab.slow)), None) if p.variant == "stab" else (ema(8, of(3)), ema(9, of(10)), ema(10, 0.5))
        self.frob, self.frob_rows = list(frob or []), frob_rows
        self.n_trend = p.stab.z_win if p.variant == "stab" else p.exp.win
        self.trend = list(trend or [])
        self.window = SortedWindow(self.n_trend)
        for x in self.trend:
            self.window.push(x)

    def step(self, row: dict) -> dict:
        """The means after a day; a day without full correlations only moves the gains and losses."""
        worst = nan
        for (up, down), s in zip(self.sides, DAMPED):
            r = row[f"r_{name(s)}"]
            gained, lost = up.push(max(r, 0.0) ** 2 if not isnan(r) else nan), down.push(max(-r, 0.0) ** 2 if not isnan(r) else nan)
            ratio = min(max(lost / (gained + 1e-12), 0.0), 5.0)
            worst = ratio if isnan(worst) else worst if isnan(ratio) else max(worst, ratio)
        if isnan(row["stability"]):
            return {}
        e3, e10 = self.e3.push(row["stability"]), self.e10.push(row["stability"])
        self.frob = [*self.frob, row["frob"]][-self.frob_rows :]
        held = np.array(self.frob)
        known = held[~np.isnan(held)]
        sd = known.std(ddof=1) if len(known) > 1 else 0.0
        frob_z = (row["frob"] - known.mean()) / sd if sd > 0 else nan
        dampened = max(0.5, 1 / (1 + 0.5 * max(0.0, (1.0 if isnan(worst) else worst) - 1.2)))
        j = float(np.tanh((0.0 if isnan(row["flux_raw"]) else row["flux_raw"]) / 0.25)) * dampened
        before_j, before_mm = self.numbers[11], self.numbers[12]
        slope, trend = j - before_j, row["mm"] - before_mm
        self.numbers[11], self.numbers[12] = j, row["mm"]
        diffusion = j - 0.5 * max(0.0, 0.0 if isnan(trend) else trend) - 0.15 * max(0.0, 0.0 if isnan(slope) else -slope)
        out = {"smoothed": e10, "delta": e3 - e10, "bear_ratio": worst, "frob_z": frob_z, "j": j, "flux_slope": slope, "mm_trend": trend, "diffusion": diffusion}
        return out | (self._overlay(row) if self.p.variant == "stab" else self._ratio(row, diffusion) if self.p.variant == "exp" else {})

    def _remembered(self, x: float) -> float:
        """The robust deviation of the last values with ``x``."""
        self.trend = [*self.trend, x][-self.n_trend :]
        self.window.push(x)
        return (1.4826 * self.window.spread() or nan) if len(self.window.values) >= 5 else nan

    def _overlay(self, row: dict) -> dict:
        slope = self.a.push(row["stability"]) - self.b.push(row["stability"])
        return {"s_slope": slope, "s_z": slope / self._remembered(slope)}

    def _ratio(self, row: dict, diffusion: float) -> dict:
        speed = 0.0 if isnan(row["v_pc1"]) else abs(row["v_pc1"])
        ratio = self.c.push(diffusion / (self.p.exp.lam * speed + 1e-6))
        filled = 0.0 if isnan(ratio) else ratio
        st, before = self.a.push(filled) - self.b.push(filled), self.numbers[13]
        self.numbers[13] = st
        return {"ratio": ratio, "st": st, "d_st": st - before, "st_before": before, "st_sigma": self._remembered(st)}


class Runs:
    """Streaks, drift epoch and sticky state of one universe, as ``flow.conditions`` and ``flow.decide`` have them."""

    NAMES = ("guard", "drift", "calm", "down", "up", "flat", "epoch", "state", "on", "off")

    def __init__(self, p: Flow, held: list[int] | None = None):
        self.p, self.held = p, dict(zip(self.NAMES, held or [0] * len(self.NAMES)))

    def _run(self, key: str, goes_on: bool) -> int:
        self.held[key] = self.held[key] + 1 if goes_on else 0
        return self.held[key]

    def step(self, row: dict) -> int:
        h, p = self.held, self.p
        guard = self._run("guard", row["guard_now"])
        off, need, flat = row["off_now"] or (row["guard_now"] and guard >= row["guard_need"]), 1, False
        drift, calm = self._run("drift", row["drift_now"]), self._run("calm", not row["drift_now"])
        h["epoch"] = 1 if drift >= p.drift_days else 0 if calm >= p.drift_cool else h["epoch"]
        if p.variant == "stab":
            down, up = self._run("down", row["down_now"]), self._run("up", row["up_now"])
            flat = self._run("flat", row["flat_now"]) >= 2
            off = True if row["plunge_now"] else False if row["rising_now"] else off or down >= p.stab.lag_down
            need = p.stab.up_confirm_off if up >= p.stab.lag_up else 1
        on_run, off_run = self._run("on", row["raw_on"]), self._run("off", off)
        if h["state"] == 1:
            h["state"] = -1 if off and off_run >= need else 1
        elif h["state"] == -1:
            h["state"] = 1 if on_run >= row["confirm"] else -1
        else:
            lean = (row["j"] > 0) - (row["j"] < 0) if p.variant == "exp" else 0
            h["state"] = -1 if off_run else 1 if on_run >= row["confirm"] else lean
        h["state"] = 0 if flat else -1 if h["epoch"] == 1 else h["state"]
        return h["state"]


class _Daily(StatefulProcessor):
    """Rows of a universe in the order of days; those at or before the last day seen are passed over."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "idx long")
        self.open(handle)

    def new_rows(self, rows: Iterator[pd.DataFrame], timers) -> pd.DataFrame:
        d = pd.concat(list(rows), ignore_index=True).sort_values("idx", kind="stable").drop_duplicates("idx")
        last = self.last.get()[0] if self.last.exists() else -1
        d = d[d["idx"] > last]
        if len(d):
            self.last.update((int(d["idx"].iloc[-1]),))
            if self.keep_ms:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.keep_ms)
        return d

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.last, *self.states()):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Means(_Daily):
    def __init__(self, p: Flow, kept: list[str], frob_rows: int, keep_ms: int | None):
        super().__init__(keep_ms)
        self.p, self.kept, self.frob_rows = p, kept, frob_rows

    def open(self, handle) -> None:
        self.numbers = handle.getValueState("numbers", "x array<double>")
        self.frob, self.trend = handle.getListState("frob", "x double"), handle.getListState("trend", "x double")

    def states(self) -> tuple:
        return self.numbers, self.frob, self.trend

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        d = self.new_rows(rows, timers)
        if not len(d):
            return
        listed = lambda state: [x[0] for x in state.get()] if state.exists() else []
        memory = Memory(self.p, list(self.numbers.get()[0]) if self.numbers.exists() else None, listed(self.frob), listed(self.trend), self.frob_rows)
        used = ["stability", "frob", "flux_raw", "mm", "v_pc1", *(f"r_{name(s)}" for s in DAMPED)]
        out = [memory.step(r) for r in d[used].astype(float).to_dict("records")]
        self.numbers.update((memory.numbers,))
        for state, values in ((self.frob, memory.frob), (self.trend, memory.trend)):
            state.clear()
            if values:
                state.put([(float(x),) for x in values])
        known = [i for i, x in enumerate(out) if x]
        if known:
            made = pd.DataFrame([out[i] for i in known], columns=[*MEANS, *TRENDS[self.p.variant]])
            yield pd.concat([d.iloc[known].reset_index(drop=True)[self.kept], made.astype(float)], axis=1)


class Decision(_Daily):
    def __init__(self, p: Flow, kept: list[str], keep_ms: int | None):
        super().__init__(keep_ms)
        self.p, self.kept = p, kept

    def open(self, handle) -> None:
        self.runs = handle.getValueState("runs", "x array<int>")

    def states(self) -> tuple:
        return (self.runs,)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        d = self.new_rows(rows, timers)
        if not len(d):
            return
        runs = Runs(self.p, list(self.runs.get()[0]) if self.runs.exists() else None)
        state, executed, held = [], [], runs.held["state"]
        for r in d.to_dict("records"):
            executed.append(held)
            held = runs.step(r)
            state.append(held)
        self.runs.update(([int(runs.held[k]) for k in Runs.NAMES],))
        yield d[self.kept].assign(state=np.array(state, np.int32), executed=np.array(executed, np.int32))


def flow_stream(days: DataFrame, fitted: DataFrame | tuple[float, float], p: Flow = Flow(), frob_rows: int = 63, forget_after: str | None = None) -> DataFrame:
    """``universe, idx, d, j, guard, score, state, executed`` of a stream of ``days``: the same as ``flow.decided`` has for the whole history.

    The session needs the state store provider ``PROVIDER``.  In batch the spread of the matrix norm looks back over a quarter of the history's
    rows (15 to 63), here over ``frob_rows``; from 252 days on both are 63.
    """
    keep_ms = int(pd.Timedelta(forget_after).total_seconds() * 1000) if forget_after else None
    mode = "processingTime" if keep_ms else "none"
    typed = {f.name: f.dataType.simpleString() for f in days.schema.fields}
    made = dict.fromkeys((*MEANS, *TRENDS[p.variant]), "double")
    kept = [c for c in days.columns if c not in made]
    first = ", ".join(f"`{c}` {t}" for c, t in ({c: typed[c] for c in kept} | made).items())
    d = days.groupBy(U).transformWithStateInPandas(Means(p, kept, frob_rows, keep_ms), first, "append", mode).withColumns({c: finite(c) for c in made})
    d = flow.guarded_columns(d.withColumn("damp", frame.damp(F.col("bear_ratio"))))
    d = flow.signals(flow.with_thresholds(d, fitted, p), F.col("on"), F.col("off"), p)
    flags = {"off_now": "__off", "guard_now": "__guard", "guard_need": "__need", "drift_now": "__drift"} | ({f"{k}_now": f"__{k}" for k in ("down", "up", "flat", "rising", "plunge")} if p.variant == "stab" else {})
    shown = {U: "string", "idx": typed["idx"], "d": typed["d"], "j": "double", "guard": "double", "score": "double"}
    rows = d.select(*shown, "raw_on", "confirm", *(F.col(c).alias(k) for k, c in flags.items()))
    second = ", ".join(f"`{c}` {t}" for c, t in shown.items()) + ", state int, executed int"
    return rows.groupBy(U).transformWithStateInPandas(Decision(p, list(shown), keep_ms), second, "append", mode)
