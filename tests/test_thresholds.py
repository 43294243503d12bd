"""Exact quantiles of groups of any size, and thresholds that each universe has for itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Flow, Thresholds
from tidemark.operators import quantiles
from tidemark.plans import engines, flow, frame
from test_units import panel

U = "universe"
SHARES = [0.0, 0.244, 0.5, 0.715, 1.0]


def groups(spark, seed, sizes):
    rng = random.Random(seed)
    rows = [(g, rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), None])) for g, n in sizes.items() for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(4)


@pytest.mark.parametrize("k", [8, 200])
def test_large_groups_equal_sorting(spark, k):
    """With coarse sketches too, whose bounds have to be widened."""
    rows, df = groups(spark, k, {"a": 4000, "b": 30, "c": 900, None: 1500, "one": 3})
    got = {r.g: r for r in quantiles.exact(df, "x", SHARES, ("g",), exact_rows=100, k=k).collect()}
    for g in {g for g, _ in rows}:
        x = [v for h, v in rows if h == g and v is not None]
        if x:
            assert got[g].n == len(x) and got[g].q == pytest.approx(np.quantile(x, SHARES).tolist(), abs=1e-12)
        else:
            assert g not in got


def test_small_groups_equal_large_ones(spark):
    _, df = groups(spark, 5, {"a": 300, "b": 301})
    plain = lambda d: sorted((r.g, r.n, tuple(round(v, 12) for v in r.q)) for r in d.collect())
    assert plain(quantiles.exact(df, "x", SHARES, ("g",))) == plain(quantiles.exact(df, "x", SHARES, ("g",), exact_rows=10, k=64))
    assert quantiles.exact(df.limit(0), "x", SHARES, ("g",)).count() == 0


def test_sketches_of_parts_merge(spark):
    """The sketch of two months together is close to the quantile of both, and each month is read once."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("month"), F.lit("u").alias("g"), (F.col("id") * 7919 % 20_000 / 20_000).alias("x"))
    parts = quantiles.sketches(df, "x", ("g", "month"))
    assert parts.count() == 2
    row = quantiles.estimated(quantiles.merged(parts, ("g",)), [0.3, 0.7]).first()
    assert row.n == 20_000 and row.q == pytest.approx([0.3, 0.7], abs=0.01)


@pytest.fixture(scope="module")
def three(spark):
    """Three universes of different markets and lengths, and each alone."""
    alone = {f"u{k}": panel(spark, 150 + 20 * k, seed=k + 1).withColumn(U, F.lit(f"u{k}")).persist() for k in range(3)}
    both = alone["u0"].unionByName(alone["u1"]).unionByName(alone["u2"])
    return both, alone


def plain(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("variant", ["exp", "stab"])
def test_together_equals_alone(spark, three, variant):
    """The flow engine over three universes gives each the states it has alone, though their thresholds differ."""
    both, alone = three
    p = Flow(variant, q_on=0.6, q_off=0.4, j_on=0.0, j_off=0.0)
    together = flow.flow(both, 20, p).select(U, "idx", "state", "on", "off").collect()
    assert len({(r.on, r.off) for r in together}) == 3
    for name, one in alone.items():
        want = plain(flow.flow(one, 20, p).select("idx", "state", "on", "off"), "idx", "state", "on", "off")
        assert sorted((r.idx, r.state, r.on, r.off) for r in together if r[U] == name) == want


def test_classic_together_equals_alone(spark, three):
    both, alone = three
    fitted = engines.fit(frame.records(both, 20))
    states = engines.classic_fitted(frame.records(both, 20), fitted).collect()
    assert fitted.select("pair_on").distinct().count() == 3
    for name, one in alone.items():
        t = engines.fitted(frame.records(one, 20))
        want = plain(engines.classic(frame.records(one, 20), t), "idx", "state")
        assert sorted((r.idx, r.state) for r in states if r[U] == name) == want


def test_frozen_thresholds(spark, three):
    """A kept table decides later days; a universe it does not know takes the fixed thresholds; plain numbers hold for all."""
    both, alone = three
    p = Flow("exp", q_on=0.6, q_off=0.4, j_on=0.0, j_off=0.0)
    cols = flow.columns(both, 20).persist()
    kept = flow.fit(cols.filter(f"{U} != 'u2'"), p)
    rows = flow.decided(cols, p, kept).select(U, "on", "off", "score_on").distinct().collect()
    assert {r[U] for r in rows} == set(alone) and [(r.on, r.off, r.score_on) for r in rows if r[U] == "u2"] == [(p.j_on, p.j_off, p.score_on)]
    assert {(r.on, r.off) for r in flow.decided(cols, p, (0.2, -0.1)).select("on", "off").distinct().collect()} == {(0.2, -0.1)}
    assert flow.thresholds(cols.filter(f"{U} = 'u0'"), p) == next((r.on, r.off) for r in rows if r[U] == "u0")
    with pytest.raises(ValueError, match="several universes"):
        flow.thresholds(cols, p)
    with pytest.raises(ValueError, match="several universes"):
        engines.fitted(frame.records(both, 20))
    cols.unpersist()


def test_short_histories_take_the_fixed_thresholds(spark):
    d = spark.createDataFrame([("a", float(i), float(i)) for i in range(60)] + [("b", 5.0, 5.0), ("c", None, None)], "universe string, j double, score double")
    got = {r[U]: (r.on, r.off, r.score_on, r.score_off) for r in flow.fit(d, Flow("exp")).collect()}
    p = Flow("exp")
    assert got["b"] == got["c"] == (p.j_on, p.j_off, p.score_on, p.score_off) and got["a"] == pytest.approx((59 * p.q_on, -0.08, 59 * 0.75, 0.40))
    empty = spark.createDataFrame([], "universe string, idx int, pair_corr double, safe_negative double")
    assert engines.fit(empty).count() == 0 and engines.fitted(empty) == Thresholds()
