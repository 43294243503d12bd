"""Column functions of the domain.  NULL is the only missing value; NaN and infinities become NULL at ``finite``."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: C) -> Column:
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clamp(c: C, low: float, high: float) -> Column:
    """``c`` within bounds; NULL stays NULL (``greatest`` alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def clamp01(c: C) -> Column:
    return clamp(c, 0.0, 1.0)


def normalize_range(c: C, low: float, high: float) -> Column:
    """Share of the way from ``low`` to ``high``, 0 for a missing value."""
    return F.coalesce(clamp01((col(c) - low) / (high - low)), F.lit(0.0))


def sigmoid(c: C, slope: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-clamp(col(c) * slope, -60, 60)))


def tanh_clip(c: C, saturation: float) -> Column:
    return F.tanh(col(c) / max(1e-9, saturation))


def softmax2(a: C, b: C, tau: float, floor: float) -> tuple[Column, Column]:
    """Two weights that sum to 1, each raised to ``floor`` before the last scaling."""
    a, b = col(a), col(b)
    top = F.greatest(a, b)
    x, y = F.exp((a - top) * tau), F.exp((b - top) * tau)
    x, y = F.greatest(x / (x + y), F.lit(floor)), F.greatest(y / (x + y), F.lit(floor))
    return x / (x + y), y / (x + y)


def levered_return(r: C, leverage: float | Column, weight: float | Column = 1.0, floor: float = -0.99) -> Column:
    scaled = col(r) * leverage * weight
    return F.coalesce(F.when(scaled.isNotNull(), F.greatest(scaled, F.lit(floor))), F.lit(0.0))


def clamp_levered(c: C) -> Column:
    return clamp(c, -0.99, 5.0)


def number(c: C, fallback: float | None = None) -> Column:
    """A text or number as double, ``%`` and ``+`` removed; the fallback where it is none."""
    parsed = finite(F.regexp_replace(col(c).cast("string"), r"[%+\s]", "").try_cast("double"))
    return parsed if fallback is None else F.coalesce(parsed, F.lit(fallback))


def ratio(a: C, b: C) -> Column:
    """``a / b``, NULL where ``b`` is 0."""
    return F.try_divide(col(a), col(b))


def gaussian_log_density(x: C, mu: C, var: C) -> Column:
    x, mu, var = col(x), col(mu), col(var)
    return -0.5 * (F.log(2 * math.pi * var) + (x - mu) * (x - mu) / var)


def logaddexp(a: C, b: C) -> Column:
    a, b = col(a), col(b)
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def platt(p: C, a: C, b: C, eps: float = 1e-5) -> Column:
    p = clamp(p, eps, 1 - eps)
    return sigmoid(col(a) * F.log(p / (1 - p)) + col(b))


def pair_weight(a: C, b: C) -> Column:
    """Weight of two categories in the coupling index: stock-bond 2, stock-gold 1.5, else 1."""
    both = F.array_sort(F.array(col(a), col(b)))
    return F.when(both == F.array(F.lit("bond"), F.lit("stock")), 2.0).when(both == F.array(F.lit("gold"), F.lit("stock")), 1.5).otherwise(1.0)


def label_state(state: C) -> Column:
    return F.when(col(state) > 0, "Risk-On").when(col(state) < 0, "Risk-Off").otherwise("Neutral")


def mean_of(*columns: C) -> Column:
    """Mean of the values that are not NULL; NULL if none is."""
    cs = [col(c) for c in columns]
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    return F.when(n > 0, total / n)


def weighted_mean_of(*parts: tuple[C, float]) -> Column:
    """Weighted mean over the parts that are not NULL."""
    cs = [(col(c), w) for c, w in parts]
    total = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in cs])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in cs])
    return F.when(weight > 0, total / weight)


def hits(*conditions: Column) -> Column:
    """How many conditions hold; a condition on a missing value doesn't."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conditions])


def mulberry32(seed: int) -> Iterator[float]:
    """The 32-bit generator of that name: numbers from 0 to below 1."""
    low, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        state = state + 0x6D2B79F5 & low
        x = (state ^ state >> 15) * (state | 1) & low
        x ^= x + (x ^ x >> 7) * (x | 61) & low
        yield (x ^ x >> 14) / 2**32


def session_of(ts: C, zone: str = "America/New_York") -> Column:
    """``pre`` before 09:30 exchange time, ``post`` from 16:00, else ``regular``."""
    local = F.from_utc_timestamp(col(ts), zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return F.when(minute < 9 * 60 + 30, "pre").when(minute >= 16 * 60, "post").otherwise("regular")
