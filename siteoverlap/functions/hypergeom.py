"""Right tail of a hypergeometric cascade.

Start with all mass at the smallest set size; each further set of size n turns
the number t of units common so far into a hypergeometric count (t marked units
among N, n drawn). The p-value is the mass at or above the observed count.

Masses are logarithms and each step handles bands alone. The product along one path
bounds the tail from below, and since what follows a term multiplies it by at most 1,
terms below ``LEFT_OUT`` of that bound, shared out over all terms there can be, are
left out: together they are less than ``LEFT_OUT`` of the p-value. Within a band all
logarithms of factorials come from tables over its few contiguous ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this, factorials come from a table; above, Stirling's series is exact to the last bits of a double.
TABLE = 256
_TABLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, TABLE)))])
#: Share of a p-value that may be left out.
LEFT_OUT = 1e-15
#: Columns of a band that are summed up at once; smaller first sets are one band.
COLUMNS = 128


def tail_of_series(x: np.ndarray) -> np.ndarray:
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_factorial(n) -> np.ndarray:
    """ln n! of each of the numbers, without a table as long as the largest."""
    n = np.asarray(n, np.int64)
    x = np.maximum(n, TABLE).astype(float) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + tail_of_series(x)
    return np.where(n < TABLE, _TABLE[np.minimum(n, TABLE - 1)], series)


def log_falling_share(n: int, k) -> np.ndarray:
    """ln n! / ((n - k)! n^k), small for k far below n; without the cancellation of logarithms of huge numbers."""
    k = np.asarray(k, np.int64)
    rest = np.maximum(n - k, TABLE).astype(float)
    a, j = max(n, TABLE) + 1.0, max(n, TABLE) - rest
    large = -(a - 0.5) * np.log1p(-j / a) + j * np.log1p((1 - j) / max(n, TABLE)) - j + tail_of_series(np.float64(a)) - tail_of_series(rest + 1.0)
    small = log_factorial(n) - log_factorial(n - k) - k * math.log(n)
    return np.where(n - k >= TABLE, large, small)


class Step:
    """Logarithm of the chance of s common units, given t of them before and n drawn of ``total``."""

    def __init__(self, n: int, total: int):
        self.n, self.total = n, total
        self.fixed = float(log_factorial(n) - log_falling_share(total, n))

    def at(self, t, s) -> np.ndarray:
        t, s = np.asarray(t, np.int64), np.asarray(s, np.int64)
        lf, share, n = log_factorial, lambda k: log_falling_share(self.total, k), self.n
        return self.fixed + lf(t) - share(t) - lf(s) - s * math.log(self.total) - lf(n - s) - lf(t - s) + share(t + n - s)

    def mode(self, t):
        return (t + 1) * (self.n + 1) // (self.total + 2)

    def block(self, t: np.ndarray, s: np.ndarray) -> np.ndarray:
        """``at`` for all (s, t) of two contiguous ranges, -inf where s is impossible; a table for each sum and difference of them."""
        n, up, gap = self.n, t[0] - s[-1], t[-1] - s[0]
        apart = np.arange(up, gap + 1)
        own = np.where(apart >= 0, -log_factorial(np.maximum(apart, 0)), -np.inf)
        joint = np.where(apart + n <= self.total, log_falling_share(self.total, np.clip(apart + n, 0, self.total)), -np.inf)
        rows = np.where(s <= n, -log_factorial(s) - s * math.log(self.total) - log_factorial(np.maximum(n - s, 0)), -np.inf)
        columns = self.fixed + log_factorial(t) - log_falling_share(self.total, t)
        return rows[:, None] + columns[None] + (own + joint)[(t[None] - s[:, None]) - up]


def path_bound(first: int, steps: list[Step], least: int) -> float:
    """Logarithm of a lower bound of the tail: the best of a few paths that end at ``least`` or above."""
    best = -math.inf
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        base, t, value = int(share * least), first, 0.0
        for k, step in enumerate(steps):
            total, n = step.total - base, step.n - base
            aim = base + (t - base + 1) * (n + 1) // (total + 2) if k < len(steps) - 1 else 0
            s = min(max(aim, least, step.mode(t), t + step.n - step.total), t, step.n)
            value += float(step.at(t, s))
            t = s
        best = max(best, value)
    return best


def edges(step: Step, t: np.ndarray, mass: np.ndarray, least: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which t have a term of at least ``floor``, and their first and last such s (each row of terms has one peak)."""
    low, high = np.maximum(np.maximum(t + step.n - step.total, 0), least), np.minimum(t, step.n)
    if floor == -math.inf:
        keep = low <= high
        return keep, low[keep], high[keep]
    peak = np.minimum(np.maximum(step.mode(t), low), high)
    keep = mass + step.at(t, peak) >= floor
    t, mass, low, high, peak = (x[keep] for x in (t, mass, low, high, peak))
    ends = []
    for end in (low, high):
        inside, outside = peak.copy(), end.copy()  # the last place known to be in, the farthest that may be
        fits = mass + step.at(t, outside) >= floor
        inside[fits] = outside[fits]
        while (np.abs(outside - inside) > 1).any():
            mid = (inside + outside) // 2
            fits = mass + step.at(t, mid) >= floor
            inside, outside = np.where(fits, mid, inside), np.where(fits, outside, mid)
            done = np.abs(outside - inside) <= 1
            outside = np.where(done, inside, outside)
        ends.append(inside)
    return keep, ends[0], ends[1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis=axis))


def cascade_tail(sizes, total: int, observed: int) -> float:
    """P(common units >= observed) for random sets of these sizes among ``total`` units."""
    sizes, total, observed = sorted(int(x) for x in sizes), int(total), int(observed)
    if total <= 0:
        return 1.0 if observed <= 0 else 0.0
    if len(sizes) < 2:
        return 1.0
    if sizes[0] < 0 or sizes[-1] > total:
        raise ValueError(f"set sizes {sizes} do not fit into {total} units")
    if observed > sizes[0]:
        return 0.0
    if observed <= 0:
        return 1.0
    steps = [Step(n, total) for n in sizes[1:]]
    floor = -math.inf
    if sizes[0] >= COLUMNS:
        floor = path_bound(sizes[0], steps, observed) + math.log(LEFT_OUT) - 2 * math.log(sizes[0] + 1) - math.log(len(steps))
    t, mass = np.array([sizes[0]]), np.zeros(1)
    for step in steps:
        keep, first, last = edges(step, t, mass, observed, floor)
        t, mass = t[keep], mass[keep]
        if not len(t):  # the sets that follow are too small
            return 0.0
        s = np.arange(first.min(), last.max() + 1)
        new = np.full(len(s), -np.inf)
        for at in range(0, len(t), COLUMNS):
            some = slice(at, at + COLUMNS)
            a, b = first[some].min() - s[0], last[some].max() + 1 - s[0]
            columns = np.arange(t[some][0], t[some][-1] + 1)
            own = np.full(len(columns), -np.inf)
            own[t[some] - columns[0]] = mass[some]
            new[a:b] = np.logaddexp(new[a:b], log_sum(step.block(columns, s[a:b]) + own, axis=1))
        t, mass = s, new
    return float(min(1.0, np.exp(log_sum(mass, axis=0))))


def overlap_pvalue(sizes: Column | str, total: Column | str, observed: Column | str) -> Column:
    """Column form of ``cascade_tail``, for one row a chromosome."""

    @F.pandas_udf("double")
    def tail(n: pd.Series, total: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([cascade_tail(a, b, c) for a, b, c in zip(n, total, k, strict=True)])

    return tail(sizes, total, observed)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Few rows with much work each, dealt to all cores: aggregates of few rows would end up in one partition."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)
