"""Window operators over rows of one series, ordered by ``idx``.

Frames count rows.  Each operator states its frame, how many values it needs and its degrees of freedom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numeric import C, clamp, col, ratio

U = "universe"


def series(*by: str, order: str = "idx") -> WindowSpec:
    return Window.partitionBy(*(by or (U,))).orderBy(order)


def frame(w: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` rows."""
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def log_return(x: C, w: WindowSpec, missing: float | None = None) -> Column:
    before = F.lag(col(x)).over(w)
    r = F.when((before > 0) & (col(x) > 0), F.ln(col(x) / before))
    return r if missing is None else F.coalesce(r, F.lit(missing))


def simple_return(x: C, w: WindowSpec, k: int = 1, missing: float | None = None) -> Column:
    r = ratio(col(x), F.lag(col(x), k).over(w)) - 1
    return r if missing is None else F.coalesce(r, F.lit(missing))


def row_number(w: WindowSpec) -> Column:
    """0 for the first row of the series."""
    return F.row_number().over(w) - 1


def mean(x: C, w: WindowSpec, n: int) -> Column:
    return F.avg(col(x)).over(frame(w, n))


def std(x: C, w: WindowSpec, n: int) -> Column:
    """Population deviation; needs a full frame and two values."""
    f = frame(w, n)
    return F.when((row_number(w) >= n - 1) & (F.count(col(x)).over(f) > 1), F.stddev_pop(col(x)).over(f))


def sample_std(x: C, w: WindowSpec, n: int, least: int = 2) -> Column:
    f = frame(w, n)
    return F.when(F.count(col(x)).over(f) >= least, F.stddev_samp(col(x)).over(f))


def zscore(x: C, w: WindowSpec, n: int = 252) -> Column:
    """From the population deviation of a full frame; NULL where it is 0."""
    return ratio(col(x) - mean(x, w, n), std(x, w, n))


def zscore_sample(x: C, w: WindowSpec, n: int, least: int = 2) -> Column:
    """From the sample deviation of at least ``least`` values; NULL where it is 0."""
    return ratio(col(x) - mean(x, w, n), sample_std(x, w, n, least))


def percentile_rank(x: C, w: WindowSpec, n: int = 252, least: int = 63) -> Column:
    """(values at most x - 1) / (values - 1) of the frame."""
    held = F.collect_list(col(x)).over(frame(w, n))
    below = F.size(F.filter(held, lambda v: v <= col(x)))
    return F.when(col(x).isNotNull() & (F.size(held) >= least) & (F.size(held) > 1), (below - 1) / (F.size(held) - 1))


def with_rsi(df: DataFrame, x: str, by: tuple[str, ...], n: int = 14, out: str = "rsi") -> DataFrame:
    """Strength index from simple averages of ``n`` steps; 100 without losses."""
    w = series(*by)
    d = df.withColumn("__step", F.col(x) - F.lag(x).over(w))
    f = frame(w, n)
    gain, loss = F.avg(F.when(F.col("__step").isNotNull(), F.greatest("__step", F.lit(0.0)))).over(f), F.avg(F.when(F.col("__step").isNotNull(), F.greatest(-F.col("__step"), F.lit(0.0)))).over(f)
    value = F.when(loss <= 1e-12, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))
    return d.withColumn(out, F.when(F.count("__step").over(f) == n, value)).drop("__step")


def with_slope(df: DataFrame, x: str, by: tuple[str, ...], n: int = 63, least: int = 20, out: str = "slope") -> DataFrame:
    """Slope of a least-squares line over the position among the frame's known values."""
    w = series(*by)
    d = df.withColumn("__at", F.when(F.col(x).isNotNull(), F.count(x).over(so_far(w))).cast("double"))
    f = frame(w, n)
    enough = F.count(x).over(f) >= max(least, int(0.3 * n), 2)
    return d.withColumn(out, F.when(enough, F.regr_slope(x, "__at").over(f))).drop("__at")


def z_momentum(x: C, w: WindowSpec, r: C, k: int = 10, v: int = 20, saturation: float = 2.0) -> Column:
    """tanh of the k-row return over the deviation of the last ``v`` simple returns ``r``."""
    sd = F.when(row_number(w) >= v, F.stddev_samp(col(r)).over(frame(w, v)))
    return F.tanh(ratio(simple_return(x, w, k), sd) / saturation)


def mad_sigma(x: C, w: WindowSpec, n: int, least: int = 5) -> Column:
    """1.4826 times the median absolute deviation from the frame's median; NULL below ``least`` values or at 0.

    The frame's values and their median go through one-element arrays, so each is worked out once a row.
    """
    middle = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2 + 1).cast("int"))) / 2
    held = F.array(F.sort_array(F.collect_list(col(x)).over(frame(w, n))))
    pair = F.transform(held, lambda a: F.struct(a.alias("a"), F.when(F.size(a) >= least, middle(a)).alias("m")))
    away = F.transform(pair, lambda p: F.sort_array(F.transform(p["a"], lambda v: F.abs(v - p["m"]))))
    return F.get(F.transform(away, lambda a: F.when(F.size(a) >= least, F.nullif(1.4826 * middle(a), F.lit(0.0)))), F.lit(0))


def hit_rate(pred: C, r: C, w: WindowSpec, n: int) -> Column:
    """Hits among the non-neutral predictions of the frame; one half if there are none."""
    p, f = col(pred), frame(w, n)
    return F.coalesce(ratio(F.sum(F.when(p * col(r) > 0, 1.0).otherwise(0.0)).over(f), F.sum(F.when(p != 0, 1.0).otherwise(0.0)).over(f)), F.lit(0.5))


def information(pred: C, r: C, w: WindowSpec, n: int) -> Column:
    """Mean of prediction times return over the return's population deviation."""
    f = frame(w, n)
    return F.avg(col(pred) * col(r)).over(f) / F.sqrt(F.greatest(F.lit(1e-12), F.var_pop(col(r)).over(f)))


def information_ratio(x: C, w: WindowSpec, n: int = 63, least: int = 30) -> Column:
    f = frame(w, n)
    return F.when(F.count(col(x)).over(f) >= least, ratio(F.avg(col(x)).over(f), F.stddev_samp(col(x)).over(f)))


def with_skill(df: DataFrame, spec: dict[str, tuple[str, str]], n: int, m: int | None = None, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``hit*, ic*`` of ``n`` rows, and with ``m`` also ``ir*`` of ``m``, for each ending of ``spec`` and its (prediction, return): one pass over a series.

    The same as ``hit_rate``, ``information`` and ``information_ratio`` (at least 30 values) of columns without gaps.
    """
    from tidemark.operators import moments as M

    made, wanted, out = {}, {}, {}
    for k, (p, r) in spec.items():
        earned = F.col(p) * F.col(r)
        made |= {f"__won{k}": F.when(earned > 0, 1.0).otherwise(0.0), f"__spoke{k}": F.when(F.col(p) != 0, 1.0).otherwise(0.0), f"__earned{k}": earned.cast("double")}
        wanted |= {f"__mw{k}": M.Mean(f"__won{k}", n), f"__ms{k}": M.Mean(f"__spoke{k}", n), f"__me{k}": M.Mean(f"__earned{k}", n), f"__sr{k}": M.Deviation(r, n, 0, 1)}
        out |= {f"hit{k}": F.coalesce(ratio(f"__mw{k}", f"__ms{k}"), F.lit(0.5)), f"ic{k}": F.col(f"__me{k}") / F.sqrt(F.greatest(F.lit(1e-12), F.pow(f"__sr{k}", 2)))}
        if m:
            wanted |= {f"__rm{k}": M.Mean(f"__earned{k}", m, 30), f"__rs{k}": M.Deviation(f"__earned{k}", m, 1, 30)}
            out[f"ir{k}"] = ratio(f"__rm{k}", f"__rs{k}")
    return M.with_moments(df.withColumns(made), wanted, by).withColumns(out).drop(*made, *wanted)


def correlation(x: C, y: C, over: WindowSpec | None = None, zero: float | None = 0.0) -> Column:
    """Pairwise correlation within [-1, 1]; ``zero`` where a variance is 0."""
    known = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(known, col(x)), F.when(known, col(y))
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    c = clamp(ratio(at(F.covar_pop(a, b)), at(F.stddev_pop(a)) * at(F.stddev_pop(b))), -1, 1)
    return c if zero is None else F.coalesce(c, F.lit(zero))


def rolling_correlation(pair_rows: DataFrame, n: int, by: tuple[str, ...] = (U, "s1", "s2"), zero: float | None = 0.0, least: int | None = None) -> DataFrame:
    """``pair_rows(x, y)`` with ``corr`` where the frame holds ``least`` (default all ``n``) pairs; other rows go."""
    f = frame(series(*by), n)
    both = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(f)
    return pair_rows.withColumns({"corr": correlation("x", "y", f, zero), "__n": both}).filter(F.col("__n") >= (least or n)).drop("__n")


def with_next(df: DataFrame, *columns: str, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``next_*``: the values of the row after."""
    w = series(*by)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def compounded(r: C, w: WindowSpec, skip: float = 0.0) -> Column:
    """Product of 1 + r so far; a missing return counts as ``skip``.  Returns stay above -1."""
    return F.exp(F.sum(F.ln(1 + F.coalesce(col(r), F.lit(skip)))).over(so_far(w)))


def drawdown(equity: C, w: WindowSpec) -> Column:
    return ratio(equity, F.max(col(equity)).over(so_far(w))) - 1
