"""Statistics: intervals, tests and distances. Python runs only where no built-in expression can."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

EXACT_BELOW = 25


def rate(hits: Column, total: Column) -> Column:
    """hits / total, null where nothing can be decided."""
    return F.try_divide(hits.cast("double"), total.cast("double"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Point estimate and Wilson score bounds; (0, 0, 1) without a sample."""
    p = successes / n
    d = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / d
    none = n == 0
    return (
        F.when(none, 0.0).otherwise(p),
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)),
        F.when(none, 1.0).otherwise(F.least(F.lit(1.0), centre + half)),
    )


@F.pandas_udf(DoubleType())
def mcnemar_p(b01: pd.Series, b10: pd.Series) -> pd.Series:
    """Two-sided p-value of discordant pairs: exact binomial if few, else chi-square with continuity correction."""

    def p(x: int, y: int) -> float:
        n = x + y
        if n == 0:
            return 1.0
        if n < EXACT_BELOW:
            return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(x, y) + 1)) / 2**n)
        return math.erfc(math.sqrt((abs(x - y) - 1) ** 2 / n / 2))

    return pd.Series([p(int(x), int(y)) for x, y in zip(b01, b10)])


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance: edits and swaps of neighbours, no part edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def within_band(baseline: Column, current: Column, percent: float) -> Column:
    """Whether `current` lies within +-percent of `baseline`; a baseline of 0 admits 0 only."""
    return F.when(baseline == 0, current == 0).otherwise(F.abs(current - baseline) <= baseline * (percent / 100) + 1e-9)


def under_ceiling(baseline: Column, current: Column, percent: float) -> Column:
    return F.when(baseline == 0, current == 0).otherwise(current <= baseline * (1 + percent / 100) + 1e-9)


def percent_saved(baseline: Column, ours: Column) -> Column:
    """Percentage saved against the baseline, 0 where that is 0."""
    return F.when(baseline == 0, 0.0).otherwise((baseline - ours) / baseline * 100)


def log2_bucket(micros: Column, buckets: int = 19) -> Column:
    """Histogram bucket: floor(log2) of the microseconds, from 0 to buckets - 1."""
    return F.least(F.greatest(F.length(F.bin(F.greatest(micros.cast("long"), F.lit(1)))) - 1, F.lit(0)), F.lit(buckets - 1)).cast("int")


def iso_millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def uptime_hours(seconds: Column) -> Column:
    return F.floor(seconds / 3600)


def estimated_cost(tasks: int, turns: int, tokens_in: int, tokens_out: int, price_in: float, price_out: float) -> float:
    """Cost of a run in the price's unit; prices are for a million tokens."""
    return tasks * turns * (tokens_in * price_in + tokens_out * price_out) / 1e6
