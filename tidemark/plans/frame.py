"""The daily frame: one row a day with returns, the rolling correlation of every pair, momenta and record columns.

A pair is a column, not a row: correlations and deviations of all of them come from one pass over a series with running
sums (``operators/moments.py``), the rest is expressions of the row and its neighbours, so nothing is joined.  ``records`` has the same values with a row a pair, for queries that want them.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import BASE, CATEGORY, CLUSTER, SIGNALS, SYMBOLS, pair_kind, pairs
from tidemark.functions.numeric import clamp01, finite, mean_of, ratio, weighted_mean_of
from tidemark.operators import eigen, moments
from tidemark.operators.folds import ema_values, per_series
from tidemark.operators.rolling import log_return, series, simple_return
from tidemark.plans.records import cell, correlation_spec, name, wide_aligned

U = "universe"
DAMPED = (BASE, "IWM", "BTC-USD")


def with_returns(wide: DataFrame) -> DataFrame:
    """Log returns ``r_*`` and simple returns ``s_*`` of every symbol."""
    w = series(U)
    return wide.withColumns({f"r_{name(s)}": log_return(f"c_{name(s)}", w) for s in SYMBOLS} | {f"s_{name(s)}": simple_return(f"c_{name(s)}", w) for s in SYMBOLS})


def with_moments(d: DataFrame, window: int, k: int = 10, v: int = 20, saturation: float = 2.0) -> DataFrame:
    """In one pass the correlation ``k_*`` of every pair and the deviation of the last ``v`` simple returns; z-momentum ``z_*`` from it."""
    spread = {f"__sd_{name(s)}": moments.Deviation(f"s_{name(s)}", v, 1, 2, v) for s in SYMBOLS}
    d = moments.with_moments(d, correlation_spec((window,)) | spread)
    z = {f"z_{name(s)}": F.tanh(ratio(simple_return(f"c_{name(s)}", series(U), k), F.col(f"__sd_{name(s)}")) / saturation) for s in SYMBOLS}
    return d.withColumns(z).drop(*spread)


def triangle(symbols: tuple[str, ...]) -> Column:
    """The upper triangle of the day's matrix; NULL if a pair is missing."""
    cells = [F.col(cell(a, b)) for a, b in pairs(symbols)]
    return F.when(reduce(lambda x, y: x & y, [c.isNotNull() for c in cells]), F.array(*cells))


def _mean(cells: list[Column]) -> Column:
    return F.coalesce(mean_of(*cells), F.lit(0.0))


def with_record(d: DataFrame) -> DataFrame:
    """Coupling index and sub-indices of the signals' pairs."""
    weigh = {frozenset(("stock", "bond")): 2.0, frozenset(("stock", "gold")): 1.5}
    kinds = {p: (CATEGORY[p[0]], CATEGORY[p[1]]) for p in pairs(SIGNALS)}
    of = lambda test: [F.col(cell(*p)) for p, k in kinds.items() if test(*k)]
    plain = ("stock", "bond", "gold")
    return d.withColumns({
        "stability": weighted_mean_of(*((F.abs(cell(*p)), weigh.get(frozenset(k), 1.0)) for p, k in kinds.items())),
        "stock_crypto": _mean([F.abs(c) for c in of(lambda a, b: {a, b} == {"stock", "crypto"})]), "traditional": _mean([F.abs(c) for c in of(lambda a, b: a in plain and b in plain)]),
        "safe_negative": _mean([F.greatest(F.lit(0.0), -c) for c in of(lambda a, b: (a == "stock") != (b == "stock") and a in plain and b in plain)]), "pair_corr": F.col(cell("IWM", "BTC-USD")),
    })


def records(panel: DataFrame, window: int = 30) -> DataFrame:
    """The record of every day with its prices and returns, without what only the flow engines need."""
    return with_record(with_moments(with_returns(wide_aligned(panel)), window)).filter("stability is not null")


def with_flux(d: DataFrame) -> DataFrame:
    """``flux_raw, intensity, apdf, pcon, rb, frob``, as ``flow.pair_flux`` and ``eigen.frobenius_change`` have them."""
    w = series(U)
    z = {s: F.coalesce(f"z_{name(s)}", F.lit(0.0)) for s in SIGNALS}
    d = d.withColumns({f"d{cell(*p)}": F.col(cell(*p)) - F.lag(cell(*p)).over(w) for p in pairs(SIGNALS)})
    cross, all_, moved = [], [], []
    for p in pairs(SIGNALS):
        kind, (a, b) = pair_kind(*p), (p if CLUSTER[p[0]] != "safe" or pair_kind(*p) != "cross" else p[::-1])
        weight, x, y, step = F.pow(F.abs(cell(*p)), 1.5), z[a], z[b], F.col(f"d{cell(*p)}")
        if kind == "cross":
            cross.append((weight, x - y))
            all_.append((weight, x - y, x > y))
        elif kind == "risk":
            all_.append((weight, (x + y) / 2, (x > 0) & (y > 0)))
            moved.append((F.when(step.isNotNull(), weight), step * F.signum(x + y)))
        else:
            all_.append((weight, -(x + y) / 2, (x <= 0) & (y <= 0)))
    total = lambda xs: reduce(lambda s, x: s + x, [F.coalesce(x, F.lit(0.0)) for x in xs])
    share = lambda rows: F.try_divide(total([a * b for a, b in rows]), total([a for a, _ in rows]))
    steps = [F.col(f"d{cell(*p)}") for p in pairs(SIGNALS)]
    d = d.withColumns({
        "flux_raw": share(cross), "intensity": share([(a, F.abs(b)) for a, b in cross]), "apdf": F.tanh(F.coalesce(share([(a, b) for a, b, _ in all_]), F.lit(0.0)) / 0.25),
        "pcon": clamp01(share([(a, c.cast("double")) for a, _, c in all_])), "rb": F.tanh(F.coalesce(share(moved), F.lit(0.0)) / 0.25),
        "frob": F.when(F.coalesce(*steps).isNotNull(), F.sqrt(2 * total([s * s for s in steps]) / len(SIGNALS) ** 2)),
    })
    return d.drop(*(f"d{cell(*p)}" for p in pairs(SIGNALS)))


def velocity(pc1: str, symbols: tuple[str, ...]) -> Column:
    """tanh of the momenta along the first component."""
    z = F.array(*(F.coalesce(f"z_{name(s)}", F.lit(0.0)) for s in symbols))
    dot = F.aggregate(F.zip_with(pc1, z, lambda e, x: e * x), F.lit(0.0), lambda s, x: s + x)
    size = F.aggregate(pc1, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.tanh(F.try_divide(dot, size) / 0.5)


def with_means(d: DataFrame, span: int = 60) -> DataFrame:
    """In one ordered pass: ``smoothed, delta`` of the stability, the bear ratio of three symbols, ``frob_z``."""

    def fold(pdf: pd.DataFrame) -> dict:
        e3, e10 = ema_values(pdf["stability"], 3), ema_values(pdf["stability"], 10)
        worst = []
        for s in DAMPED:
            r = pdf[f"r_{name(s)}"]
            up, down = ema_values(r.clip(lower=0) ** 2, span), ema_values((-r).clip(lower=0) ** 2, span)
            worst.append((down / (up + 1e-12)).clip(0, 5))
        known = pdf["stability"].notna()
        n = min(63, max(15, int(known.sum()) // 4))
        frob = pdf["frob"][known]
        held = frob.rolling(n, min_periods=2)
        z = ((frob - held.mean()) / held.std(ddof=1).replace(0, float("nan"))).reindex(pdf.index)
        return {"smoothed": e10, "delta": e3 - e10, "bear_ratio": pd.concat(worst, axis=1).max(axis=1), "frob_z": z}

    used = ("stability", "frob", *(f"r_{name(s)}" for s in DAMPED))
    return per_series(d, fold, dict.fromkeys(("smoothed", "delta", "bear_ratio", "frob_z"), "double"), using=used).withColumns({c: finite(c) for c in ("smoothed", "delta", "bear_ratio", "frob_z")})


def inputs(panel: DataFrame, window: int = 30, six: bool = False) -> DataFrame:
    """All of ``daily`` that a bounded number of rows before gives (no exponential means), for every day, also without full correlations."""
    w = series(U)
    d = with_flux(with_record(with_moments(with_returns(wide_aligned(panel)), window)))
    ret = lambda s, k: simple_return(f"c_{name(s)}", w, k)
    d = d.withColumns(
        {f"ret5_{name(s)}": ret(s, 5) for s in SIGNALS} | {f"ret3_{name(s)}": ret(s, 3) for s in SIGNALS if CLUSTER[s] == "risk"}
        | {f"ret10_{name(s)}": ret(s, 10) for s in ("IWM", "BTC-USD")} | {"bench5": ret(BASE, 5), "bench10": ret(BASE, 10), "bench20": ret(BASE, 20)}
    )
    matrices = {"": SIGNALS} | ({"_six": SYMBOLS} if six else {})
    d = d.withColumns({f"upper{k}": triangle(s) for k, s in matrices.items()})
    d = d.withColumns({f"mm{k}": eigen.absorption(f"upper{k}") for k in matrices} | {f"pc1{k}": eigen.first_component(f"upper{k}") for k in matrices})
    d = d.withColumns({"v_six" if k else "v_pc1": velocity(f"pc1{k}", s) for k, s in matrices.items()})
    return d.drop(*(f"{c}{k}" for k in matrices for c in ("upper", "pc1")))


def damp(bear_ratio: Column) -> Column:
    return F.greatest(F.lit(0.5), 1 / (1 + 0.5 * F.greatest(F.lit(0.0), F.coalesce(bear_ratio, F.lit(1.0)) - 1.2)))


def daily(panel: DataFrame, window: int = 30, six: bool = False) -> DataFrame:
    """The frame of all days with full correlations.

    Columns: prices ``c_*, o_*``, returns ``r_*, s_*``, momenta ``z_*``, correlations ``k_*``, the record, ``mm`` and ``v_pc1`` of
    the signals (with ``six`` also ``mm_six, v_six`` of all symbols), flux columns, means, and returns of the
    symbols over 3, 5, 10 and 20 rows where engines use them.
    """
    d = with_means(inputs(panel, window, six))
    return d.withColumn("damp", damp(F.col("bear_ratio"))).drop("bear_ratio").filter("stability is not null")
