"""Running totals over a whole table, from the totals of its range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import fresh
from tracemill.storage import written


def running_totals(
    df: DataFrame, order: list[str], sums: dict[str, Column], groups: list[str] | None = None
) -> DataFrame:
    """``df`` with one long column per entry of ``sums``: its total over all earlier rows of the group.

    Rows are dealt out by ranges of (``groups``, ``order``), so that a group with most of the rows spans
    many partitions. Each partition is numbered and stored; its totals are one row per group and
    partition, their running sums start each partition, and rows are summed within their own partition
    only. Nothing is gathered but those totals.

    ``order`` should tell rows apart (else equal rows take any order among themselves). Nulls in
    ``groups`` are a group of their own, nulls in ``order`` come first.
    """
    groups = groups or []
    part, *temps = fresh(df, "part", *(f"part_{name}" for name in sums))
    dealt = df.repartitionByRange(*(F.col(c) for c in groups + order))
    dealt = written(dealt.withColumn(part, F.spark_partition_id()), "ranges")

    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*groups, part).agg(*(F.sum(v).alias(t) for v, t in zip(sums.values(), temps, strict=True)))
    starts = totals.select(
        *(F.col(g).alias(f"{g}__") for g in groups),
        F.col(part).alias(f"{part}__"),
        *(F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(t) for t in temps),
    )
    starts = written(starts, "starts")

    within = (
        Window.partitionBy(*groups, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = dealt.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(n) for n, v in sums.items()))
    same = F.col(part) == F.col(f"{part}__")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"{g}__"))
    kept = [c for c in df.columns]
    return inner.join(starts, same).select(
        *kept, *((F.col(n) + F.col(t)).cast("long").alias(n) for n, t in zip(sums, temps, strict=True))
    )
