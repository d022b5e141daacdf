"""Dealing rows into key ranges whose number is known beforehand, so that order survives across partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys sampled for each range bound.
PER_BOUND = 60


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bounds(keys: DataFrame, n: int, rows: int) -> list[tuple[int, int]]:
    """At most n - 1 ascending cut points of a table of two longs, from a sample of about PER_BOUND * n rows.

    They only balance the ranges; any sample gives right results. The sample is bounded by n, not by the rows.
    """
    a, b = keys.columns
    share = min(1.0, PER_BOUND * n / max(1, rows))
    sample = sorted((r[0], r[1]) for r in keys.where(f"pmod(xxhash64(`{a}`, `{b}`, 7L), 1000000007) < {share} * 1000000007").collect())
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


def range_of(a: Column, b: Column, cuts: list[tuple[int, int]]) -> Column:
    """Number of cut points at or below (a, b). Only the two longs go to Python."""
    first, second = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.to_numpy(np.int64), y.to_numpy(np.int64)
        low, high = np.searchsorted(first, x, "left"), np.searchsorted(first, x, "right")
        for i in np.flatnonzero(high > low):
            low[i] += np.searchsorted(second[low[i] : high[i]], y[i], "right")
        return pd.Series(low.astype(np.int32))

    return F.pandas_udf(run, "int")(a, b)
