"""Running moments and sliding order statistics against plain windows."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import WINDOWS
from tidemark.operators import moments as M
from tidemark.operators import order as O
from tidemark.operators import rolling as W


def series(rng, n, gaps=0.1):
    return [None if rng.random() < gaps else round(rng.gauss(0, 1), rng.choice([1, 12])) for _ in range(n)]


def frame(spark, columns, universe="u"):
    n = len(next(iter(columns.values())))
    rows = [(universe, i, *(c[i] for c in columns.values())) for i in range(n)]
    return spark.createDataFrame(rows, "universe string, idx int, " + ", ".join(f"{c} double" for c in columns))


def held(x, i, n):
    return [v for v in x[max(0, i - n + 1) : i + 1] if v is not None]


@pytest.mark.parametrize("rows", [1, 19, 20, 21, 143])
@pytest.mark.parametrize("n", [1, 2, 20, 63])
def test_moments_equal_plain_windows(rows, n):
    rng = random.Random(rows * 100 + n)
    x, y = series(rng, rows), series(rng, rows)
    arrays = {k: np.array([math.nan if v is None else v for v in c]) for k, c in (("x", x), ("y", y))}
    got = M.evaluate(arrays, {"m": M.Mean("x", n), "p": M.Deviation("x", n), "s": M.Deviation("x", n, 1), "z": M.ZScore("x", n, first=5), "c": M.Correlation("x", "y", n, 2)})
    for i in range(rows):
        h = held(x, i, n)
        both = [(a, b) for a, b in zip(x[max(0, i - n + 1) : i + 1], y[max(0, i - n + 1) : i + 1]) if a is not None and b is not None]
        near = lambda k, want: got[k][i] == pytest.approx(want, abs=1e-9, nan_ok=True)  # noqa: B023, E731
        assert near("m", np.mean(h) if h else math.nan) and near("p", np.std(h) if len(h) > 1 else math.nan) and near("s", np.std(h, ddof=1) if len(h) > 1 else math.nan)
        sd = np.std(h) if len(h) > 1 and i >= 5 else 0
        assert near("z", (x[i] - np.mean(h)) / sd if sd > 1e-12 and x[i] is not None else math.nan)
        flat = len(both) < 2 or min(np.std([b[k] for b in both]) for k in (0, 1)) < 1e-12
        assert near("c", (math.nan if len(both) < 2 else 0.0) if flat else np.corrcoef(np.array(both).T)[0, 1])


def test_no_digits_are_lost():
    """A level a million times its deviation, a long way into a series; a window that does not move has none at all."""
    rng = np.random.default_rng(1)
    x = 1e4 + rng.normal(size=200_000) * 1e-2
    x[150_000:150_100] = 12_345.678
    got = M.evaluate({"x": x}, {"s": M.Deviation("x", 30, 1)})["s"]
    for i in (29, 1000, 149_990, 199_999):
        assert got[i] == pytest.approx(np.std(x[i - 29 : i + 1], ddof=1), rel=1e-6)
    assert got[150_060] == 0


def test_zeros_stay_zero():
    x = np.array([0.0] * 50 + [1.0, 0.1, 0.7] * 10)
    got = M.evaluate({"x": x}, {"m": M.Mean("x", 20)})["m"]
    assert (got[:50] == 0).all() and got[49] == 0 and got[50] == pytest.approx(0.05)


def test_three_windows_from_one_pass_equal_columns(spark):
    rng = random.Random(5)
    df = frame(spark, {"x": series(rng, 150, 0.0), "y": series(rng, 150, 0.0)})
    got = M.correlations_over(df, {"k": ("x", "y")}, WINDOWS).toPandas()
    assert set(got["window"]) == set(WINDOWS)
    w = W.series("universe")
    want = df.select("idx", *(W.correlation("x", "y", W.frame(w, n)).alias(f"k{n}") for n in WINDOWS)).toPandas()
    for n in WINDOWS:
        a = got[got["window"] == n].sort_values("idx")["k"].to_numpy()
        assert np.isnan(a[: n - 1]).all() and a[n - 1 :] == pytest.approx(want.sort_values("idx")[f"k{n}"].to_numpy()[n - 1 :], abs=1e-9)


def test_skill_equals_columns(spark):
    rng = random.Random(8)
    df = frame(spark, {"p": [float(rng.choice([-1, 0, 0, 0, 1])) for _ in range(120)], "r": series(rng, 120, 0.0)})
    w = W.series("universe")
    d = W.with_skill(df, {"": ("p", "r")}, 10, 40).withColumns({"h": W.hit_rate("p", "r", w, 10), "i": W.information("p", "r", w, 10), "q": W.information_ratio(F.col("p") * F.col("r"), w, 40)}).toPandas()
    for a, b in (("hit", "h"), ("ic", "i"), ("ir", "q")):
        assert d[a].to_numpy(float) == pytest.approx(d[b].to_numpy(float), abs=1e-9, nan_ok=True)


def test_series_do_not_mix(spark):
    rng = random.Random(9)
    a, b = series(rng, 40), series(rng, 55)
    both = frame(spark, {"x": a}, "a").unionByName(frame(spark, {"x": b}, "b"))
    spec = {"m": M.Mean("x", 7), "s": M.Deviation("x", 7)}
    got = M.with_moments(both, spec).toPandas()
    for name, x in (("a", a), ("b", b)):
        want = M.evaluate({"x": np.array([math.nan if v is None else v for v in x])}, spec)
        mine = got[got["universe"] == name].sort_values("idx")
        assert mine["m"].to_numpy(float) == pytest.approx(want["m"], nan_ok=True) and mine["s"].to_numpy(float) == pytest.approx(want["s"], nan_ok=True)


# Order statistics.


@pytest.mark.parametrize("n", [1, 2, 5, 12, 13])
@pytest.mark.parametrize("upper", [False, True])
def test_robust_deviation_equals_sorting(n, upper):
    rng = random.Random(n)
    x = [None if rng.random() < 0.2 else rng.choice([rng.gauss(0, 1), 1.0, 2.0]) for _ in range(200)]
    got = O.deviations(np.array([math.nan if v is None else v for v in x]), n, 2, upper)
    middle = lambda s: s[len(s) // 2] if upper or len(s) % 2 else (s[len(s) // 2 - 1] + s[len(s) // 2]) / 2
    for i in range(200):
        h = sorted(held(x, i, n))
        want = 1.4826 * middle(sorted(abs(v - middle(h)) for v in h)) if len(h) >= 2 else 0
        assert got[i] == pytest.approx(want or math.nan, abs=1e-12, nan_ok=True)


def test_ranks_equal_counting():
    rng = random.Random(3)
    x = [None if rng.random() < 0.1 else float(rng.randrange(12)) for _ in range(300)]
    got = O.ranks(np.array([math.nan if v is None else v for v in x]), 25, 10)
    for i in range(300):
        h = held(x, i, 25)
        want = (sum(v <= x[i] for v in h) - 1) / (len(h) - 1) if x[i] is not None and len(h) >= 10 else math.nan
        assert got[i] == pytest.approx(want, nan_ok=True)


def test_order_columns_equal_windows(spark):
    rng = random.Random(4)
    df = frame(spark, {"x": series(rng, 90)})
    w = W.series("universe")
    d = O.with_order(df, {"rank": O.Rank("x", 20, 5), "sigma": O.Robust("x", 20)}).withColumns({"r": W.percentile_rank("x", w, 20, 5), "s": W.mad_sigma("x", w, 20)}).toPandas()
    assert d["rank"].to_numpy(float) == pytest.approx(d["r"].to_numpy(float), nan_ok=True) and d["sigma"].to_numpy(float) == pytest.approx(d["s"].to_numpy(float), nan_ok=True)
    assert O.with_order(df.limit(0), {"rank": O.Rank("x")}).count() == 0 and M.with_moments(df.limit(0), {"m": M.Mean("x", 3)}).count() == 0


def test_a_long_frame_costs_little():
    """The same rows with a window 64 times as long take less than 8 times the time: no window is sorted anew."""
    import time

    x = np.random.default_rng(2).normal(size=6000)
    took = {}
    for n in (32, 2048):
        began = time.perf_counter()
        O.deviations(x, n)
        took[n] = time.perf_counter() - began
    assert took[2048] < 8 * took[32]
    assert isinstance(pd.Series(O.ranks(x, 2048)).max(), float)
