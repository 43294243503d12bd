"""Rolling means, deviations and correlations from running sums: a row costs the same for any window.

A series is cut into blocks of the window's length.  Sums that restart at each block, forward and backward, give
every window as the end of one block and the start of the next, so nothing is ever taken away from a long sum and no
digits are lost however long the series is.  All columns, pairs and windows of a series share one grouped pass; series
run in parallel, and a series is bounded by its calendar.

Windows count rows.  Missing values are left out of a window; a window at the start is shorter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import per_series

U = "universe"
#: A variance below this part of the mean square (after the series' mean is taken off) is rounding, and counts as 0.
ROUNDING = 1e-13


@dataclass(frozen=True)
class Mean:
    """Mean of the known values of the last ``n`` rows; ``least`` of them are needed."""

    x: str
    n: int
    least: int = 1


@dataclass(frozen=True)
class Deviation:
    """Deviation with ``ddof`` degrees off, from ``least`` values in a frame that ends at row ``first`` (from 0) or later."""

    x: str
    n: int
    ddof: int = 0
    least: int = 2
    first: int = 0


@dataclass(frozen=True)
class ZScore:
    """Distance from the mean of the frame in its deviations, as ``Deviation`` has them; missing where that is 0."""

    x: str
    n: int
    ddof: int = 0
    least: int = 2
    first: int = 0


@dataclass(frozen=True)
class Correlation:
    """Of the rows of the last ``n`` where both are known, at least ``least`` (default all); ``zero`` where a variance is 0."""

    x: str
    y: str
    n: int
    least: int | None = None
    zero: float = 0.0


Moment = Mean | Deviation | ZScore | Correlation


def window_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums over the last ``n`` rows of each column of ``x`` (rows by columns), fewer at the start."""
    rows, width = x.shape
    blocks = np.zeros((-(-rows // n) * n, width))
    blocks[:rows] = x
    blocks = blocks.reshape(-1, n, width)
    from_start = np.cumsum(blocks, axis=1).reshape(-1, width)
    to_end = np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1, width)
    out = from_start[:rows].copy()
    i = np.arange(n, rows)
    i = i[(i + 1) % n > 0]  # windows that begin within the block before
    out[i] += to_end[i - n + 1]
    return out


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` less its mean with 0 for missing values, and 1 where it is known."""
    known = np.isfinite(x)
    n = np.maximum(known.sum(0), 1)
    return np.where(known, x - np.where(known, x, 0).sum(0) / n, 0.0), known.astype(float)


def _variance(s: np.ndarray, s2: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of squares about the mean; 0 where it is no more than rounding."""
    v = s2 - s * s / np.maximum(n, 1)
    return np.where(v <= ROUNDING * s2, 0.0, v)


def _singles(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean, sum of squares about it and distance from it of every window.

    The mean is that of the values as they are, so a window of zeros has exactly 0; the rest is taken off the series' mean.
    """
    x, known = _centred(values)
    width = x.shape[1]
    sums = window_sums(np.hstack([np.where(known > 0, values, 0.0), x, x * x, known]), n)
    raw, s, s2, count = (sums[:, k * width : (k + 1) * width] for k in range(4))
    some = np.maximum(count, 1)
    return count, raw / some, _variance(s, s2, count), np.where(known > 0, x - s / some, np.nan)


def _pairs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Count of the known pairs and correlation of every window; nan where a variance is 0."""
    known = np.isfinite(a) & np.isfinite(b)
    x, y = (_centred(np.where(known, v, np.nan))[0] for v in (a, b))
    width = x.shape[1]
    sums = window_sums(np.hstack([x, y, x * x, y * y, x * y, known.astype(float)]), n)
    sx, sy, sxx, syy, sxy, count = (sums[:, k * width : (k + 1) * width] for k in range(6))
    both = _variance(sx, sxx, count) * _variance(sy, syy, count)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = (sxy - sx * sy / np.maximum(count, 1)) / np.sqrt(both)
    return count, np.where(both > 0, np.clip(corr, -1, 1), np.nan)


def evaluate(series: dict[str, np.ndarray], spec: dict[str, Moment]) -> dict[str, np.ndarray]:
    """All moments of ``spec`` over one series, whose columns are in row order; missing is nan."""
    out: dict[str, np.ndarray] = {}
    rows = len(next(iter(series.values()))) if series else 0
    at = np.arange(rows)
    for n in sorted({m.n for m in spec.values()}):
        single = {k: m for k, m in spec.items() if m.n == n and not isinstance(m, Correlation)}
        names = sorted({m.x for m in single.values()})
        if names:
            values = np.column_stack([series[c] for c in names])
            count, mean, square, away = _singles(values, n)
            for k, m in single.items():
                j = names.index(m.x)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sd = None if isinstance(m, Mean) else np.sqrt(square[:, j] / np.maximum(count[:, j] - m.ddof, 0))
                    v = mean[:, j] if sd is None else sd if isinstance(m, Deviation) else np.where(sd > 0, away[:, j] / sd, np.nan)
                enough = count[:, j] >= m.least
                out[k] = np.where(enough & (at >= getattr(m, "first", 0)), v, np.nan)
        double = {k: m for k, m in spec.items() if m.n == n and isinstance(m, Correlation)}
        if double:
            count, corr = _pairs(np.column_stack([series[m.x] for m in double.values()]), np.column_stack([series[m.y] for m in double.values()]), n)
            for j, (k, m) in enumerate(double.items()):
                out[k] = np.where(count[:, j] >= (m.least or n), np.where(np.isnan(corr[:, j]), m.zero, corr[:, j]), np.nan)
    return out


def with_moments(df: DataFrame, spec: dict[str, Moment], by: tuple[str, ...] = (U,)) -> DataFrame:
    """``df`` with a column for each moment; NULL where it is missing."""
    used = tuple(sorted({c for m in spec.values() for c in ((m.x, m.y) if isinstance(m, Correlation) else (m.x,))}))
    fold = lambda p: evaluate({c: p[c].to_numpy(float) for c in used}, spec)
    return per_series(df, fold, dict.fromkeys(spec, "double"), by, used)


def correlations_over(df: DataFrame, pairs: dict[str, tuple[str, str]], windows: tuple[int, ...], by: tuple[str, ...] = (U,)) -> DataFrame:
    """``window, <columns of pairs>``: the correlations of every pair for each window length, from one pass; a row a day and window."""
    spec = {f"{k}__{n}": Correlation(x, y, n) for k, (x, y) in pairs.items() for n in windows}
    d = with_moments(df, spec, by)
    kept = [c for c in df.columns]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("window"), *(F.col(f"{k}__{n}").alias(k) for k in pairs)) for n in windows)))
    return d.select(*kept, rows.alias("__w")).select(*kept, "__w.*")
