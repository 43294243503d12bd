"""Rolling medians, robust deviations and percentile ranks from a sorted window that slides with the row.

The window's values stay sorted: the value that leaves is found and taken out by bisection, the new one put in the same
way, so nothing is sorted again.  Rank and median are places in the window; the median distance from the median is found by
bisection over two sorted halves, so a row costs some logarithms of the window and one move of its values.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass
from math import isnan, nan

import numpy as np
from pyspark.sql import DataFrame

from tidemark.operators.folds import per_series

U = "universe"
#: Makes the median distance of normal values their deviation.
NORMAL = 1.4826


class SortedWindow:
    """The known values of the last ``n`` rows, sorted."""

    def __init__(self, n: int):
        self.n, self.values, self.rows, self.at = n, [], [nan] * n, 0

    def push(self, x: float) -> None:
        """Take the next row; a missing value takes a row's place but is not held."""
        gone, self.rows[self.at] = self.rows[self.at], x
        self.at = (self.at + 1) % self.n
        if not isnan(gone):
            del self.values[bisect_left(self.values, gone)]
        if not isnan(x):
            insort(self.values, x)

    def at_most(self, x: float) -> int:
        """How many values are ``x`` or less."""
        return bisect_right(self.values, x)

    def median(self, upper: bool = False) -> float:
        v, k = self.values, len(self.values)
        return v[k // 2] if k % 2 or upper else (v[k // 2 - 1] + v[k // 2]) / 2

    def _distance(self, m: float, k: int) -> float:
        """The ``k``-th smallest distance (from 0) of a value from ``m``: the values nearest to ``m`` stand together."""
        v = self.values
        low, high = 0, len(v) - 1 - k  # the first of the k + 1 nearest values
        while low < high:
            middle = (low + high) // 2
            if m - v[middle] > v[middle + k + 1] - m:
                low = middle + 1
            else:
                high = middle
        return max(abs(m - v[low]), abs(v[low + k] - m))

    def spread(self, upper: bool = False) -> float:
        """The median distance from the median; with ``upper`` the upper of two middle values for both."""
        m, k = self.median(upper), len(self.values)
        return self._distance(m, k // 2) if k % 2 or upper else (self._distance(m, k // 2 - 1) + self._distance(m, k // 2)) / 2


def ranks(x: np.ndarray, n: int = 252, least: int = 63) -> np.ndarray:
    """(values at most x - 1) / (values - 1) of the window; missing below ``least`` values."""
    held, out = SortedWindow(n), np.full(len(x), nan)
    for i, v in enumerate(x.tolist()):
        held.push(v)
        k = len(held.values)
        if not isnan(v) and k >= least and k > 1:
            out[i] = (held.at_most(v) - 1) / (k - 1)
    return out


def deviations(x: np.ndarray, n: int, least: int = 5, upper: bool = False) -> np.ndarray:
    """Robust deviation of the window; missing below ``least`` values or at 0."""
    held, out = SortedWindow(n), np.full(len(x), nan)
    for i, v in enumerate(x.tolist()):
        held.push(v)
        if len(held.values) >= least:
            out[i] = NORMAL * held.spread(upper) or nan
    return out


@dataclass(frozen=True)
class Rank:
    x: str
    n: int = 252
    least: int = 63


@dataclass(frozen=True)
class Robust:
    x: str
    n: int
    least: int = 5
    upper: bool = False


def with_order(df: DataFrame, spec: dict[str, Rank | Robust], by: tuple[str, ...] = (U,)) -> DataFrame:
    """``df`` with a column for each statistic, all from one pass over each series; NULL where it is missing."""

    def fold(p):
        of = lambda m: p[m.x].to_numpy(float)
        return {k: ranks(of(m), m.n, m.least) if isinstance(m, Rank) else deviations(of(m), m.n, m.least, m.upper) for k, m in spec.items()}

    return per_series(df, fold, dict.fromkeys(spec, "double"), by, tuple(sorted({m.x for m in spec.values()})))
