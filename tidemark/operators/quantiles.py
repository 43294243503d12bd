"""Exact quantiles of many groups, also of groups too large for one task, from mergeable sketches.

A group of up to ``exact_rows`` values is one aggregation.  For a larger one a KLL sketch, merged from all tasks, says
between which two values each quantile must lie; a second pass counts what is below and takes only the few values
between, so the result is exact and no task sees the group.  If a sketch was too far off, its bounds are widened and
counted again.

``sketches`` and ``merged`` keep sketches by part (such as a month), so a fit over a longer history reads only the new part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sketches(df: DataFrame, value: str, by: tuple[str, ...], k: int = 2048) -> DataFrame:
    """``by, n, sketch`` of the known values; tasks send sketches on, never values."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One sketch for each ``by`` from those of its parts."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def estimated(sketched: DataFrame, shares: list[float]) -> DataFrame:
    """``sketched`` with ``q``: approximate quantiles, for fits that need not be exact."""
    return sketched.withColumn("q", F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares)))


def _same(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> Column:
    cond = F.lit(True)
    for c in by:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def _between(df: DataFrame, bounds: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """``by, share, first, below, held`` for ``bounds(by, n, share, low, high)``; ``held`` are the values within with their counts so far."""
    named = bounds.withColumnsRenamed({c: f"__{c}" for c in by})
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")).join(named, cond)
    key = [*by, "share", "n"]
    inside = F.when((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")), F.col("v")).when(F.col("v") < F.col("low"), F.lit(float("-inf")))
    counted = met.withColumn("v", inside).filter("v is not null").groupBy(*key, "v").agg(F.count("*").alias("k"))  # what is below is one row
    return counted.withColumn("upto", F.sum("k").over(Window.partitionBy(*key).orderBy("v")))


def exact(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...], exact_rows: int = 1_000_000, k: int = 2048) -> DataFrame:
    """``by, n, q``: how many values a group has and their quantiles at ``shares``, interpolated between neighbours.

    Groups without a value are left out.
    """
    small = lambda d: d.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.percentile(F.col(value).cast("double"), [float(s) for s in shares]).alias("q"))
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= exact_rows:
        return small(df)
    big = sizes.filter(F.col("n") > exact_rows).drop("n")
    in_big = df.join(big, _same(df, big, by), "left_semi")
    known = sketches(in_big, value, by, k).persist()
    out, margin, missed, found = small(df.join(big, _same(df, big, by), "left_anti")), 4.0 / k, None, None

    def bound(s: float) -> Column:  # the sketch wants a constant share
        return F.kll_sketch_get_quantile_double("sketch", F.lit(s)) if 0 < s < 1 else F.lit(float("-inf") if s <= 0 else float("inf"))

    while True:
        each = F.array(*(F.struct(F.lit(float(s)).alias("share"), bound(s - margin).alias("low"), bound(s + margin).alias("high")) for s in shares))
        bounds = known.select(*by, "n", F.inline(each))
        if missed is not None:
            bounds = bounds.join(missed, _same(bounds, missed, (*by, "share")), "left_semi")
        rows = _between(in_big, bounds, value, by)
        place = F.col("share") * (F.col("n") - 1)
        r = F.floor(place + F.lit(1e-9))
        pick = lambda rank: F.min(F.when((F.col("upto") > rank) & (F.col("v") > F.lit(float("-inf"))), F.col("v")))
        got = rows.groupBy(*by, "share", "n").agg(
            pick(r).alias("a"), pick(F.least(r + 1, F.col("n") - 1)).alias("b"), F.max(F.when(F.col("v") == F.lit(float("-inf")), F.col("upto"))).alias("below"), F.max("upto").alias("seen"),
        )
        got = got.withColumn("ok", (F.coalesce("below", F.lit(0)) <= r) & (F.col("seen") > F.least(r + 1, F.col("n") - 1)))
        got = got.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.greatest(place - r, F.lit(0.0)))
        found = got if found is None else found.filter("ok").unionByName(got)
        missed = got.filter("not ok").select(*by, "share")
        if margin > 1 or not missed.limit(1).count():
            break
        margin *= 8
    wanted = F.array(*(F.lit(float(s)) for s in shares))
    large = found.filter("ok").groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("share", "x"))).alias("m"))
    return out.unionByName(large.select(*by, "n", F.transform(wanted, lambda s: F.element_at("m", s)).alias("q")))
