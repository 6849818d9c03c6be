"""Two-decimal rounding and means that agree with binary floating point at ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2**27 + 1: multiplying by it splits a double into two halves of at most 27 bits.
_SPLIT = 134217729.0


def fmt2(x: Column) -> Column:
    """Two decimals of the exact binary value of ``x`` (0 <= x), ties to even.

    The sign of ``200 x - (2k + 1)`` is computed without rounding error by splitting ``x`` into
    a high and a low half, which says on which side of the tie the stored double lies.
    """
    k = F.floor(x * F.lit(100.0)).cast("double")
    wide = x * F.lit(_SPLIT)
    high = wide - (wide - x)
    low = x - high
    side = (high * F.lit(200.0) - (k * F.lit(2.0) + F.lit(1.0))) + low * F.lit(200.0)
    up = (side > 0) | ((side == 0) & (k % F.lit(2.0) == 1))
    return (k + F.when(up, 1.0).otherwise(0.0)) / F.lit(100.0)


def np2(x: Column) -> Column:
    """Two decimals by scaling, rounding half to even, and scaling back."""
    return F.rint(x * F.lit(100.0)) / F.lit(100.0)


def mean2(df: DataFrame, keys: Sequence[str], value: str, rounding, out: str) -> DataFrame:
    """Mean of a two-decimal column per group, rounded to two decimals: ``keys, size, out``.

    Hundredths are added as integers, with map-side combine: the result depends neither on the
    order of the rows nor on the size of a group, and no group is gathered.
    """
    hundredths = F.sum(F.rint(F.col(value) * F.lit(100.0)).cast("bigint"))
    sums = df.groupBy(*keys).agg(hundredths.alias("_s"), F.count(F.lit(1)).alias("size"))
    mean = F.col("_s").cast("double") / F.lit(100.0) / F.col("size").cast("double")
    return sums.select(*keys, "size", rounding(mean).alias(out))
