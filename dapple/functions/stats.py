"""Statistics as Column expressions; exact tails in a small Arrow UDF after aggregation."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The normal quantile of 95% intervals, the most discordant pairs of an exact p, resamples and seed of the bootstrap.
Z95 = 1.96
EXACT_N = 1000
RESAMPLES, SEED = 2000, 42


def wilson(hits: Column, n: Column, z: float = Z95) -> Column:
    """struct(lo, hi) of the Wilson interval; hits clamped to [0, n]; (0, 0) without trials."""
    n = n.cast("double")
    h = F.least(F.greatest(hits.cast("double"), F.lit(0.0)), n)
    p = F.try_divide(h, n)
    denom = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.greatest(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n), F.lit(0.0)))
    lo = F.when(n > 0, F.greatest(F.lit(0.0), (centre - half) / denom)).otherwise(0.0)
    hi = F.when(n > 0, F.least(F.lit(1.0), (centre + half) / denom)).otherwise(0.0)
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def mcnemar_p(b: int, c: int) -> float:
    """Two-sided p of discordant counts: exact binomial up to EXACT_N, then normal with continuity correction."""
    n = b + c
    if n == 0:
        return 1.0
    if n <= EXACT_N:
        tail = sum(math.comb(n, i) for i in range(min(b, c) + 1))
        return min(1.0, float(Fraction(2 * tail, 2**n)))
    z = max(0.0, abs(b - c) - 1) / math.sqrt(n)
    return math.erfc(z / math.sqrt(2))


@F.pandas_udf(DoubleType())
def mcnemar_udf(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(b, c, strict=True)])


def bootstrap(a: np.ndarray, b: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float, float]:
    """Difference of means of b and a over paired resamples: value, 2.5% and 97.5% points."""
    n = len(a)
    if n == 0:
        return 0.0, 0.0, 0.0
    d = b.astype(float) - a.astype(float)
    rng = np.random.RandomState(seed)
    means = np.array([d[rng.randint(0, n, n)].mean() for _ in range(resamples)])
    lo, hi = np.percentile(means, [2.5, 97.5])
    return float(d.mean()), float(lo), float(hi)
