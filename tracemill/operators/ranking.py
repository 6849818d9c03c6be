"""Row numbers over a whole table, without sending the table through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators.ordering import range_segments
from tracemill.storage import written

ONE_TASK_ROWS = 100_000


def ranked(
    df: DataFrame,
    order: Sequence[str],
    out: str,
    keys: Sequence[str] = (),
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """``df`` with a row number from 1 in ``order``, per ``keys`` when given.

    ``order`` must tell the rows of a key apart. Tables of up to ``one_task_rows`` rows are
    numbered by a window; larger ones by range: rows per range are counted, and each range
    starts where the ones before it end.
    """
    keys, order = list(keys), list(order)
    table = written(df, "unranked")
    if table.count() <= one_task_rows:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return table.withColumn(out, F.row_number().over(whole).cast("long"))
    ranges = range_segments(table, [*keys, *order])
    earlier = Window.partitionBy(*keys).orderBy("seg")
    offsets = (
        ranges.groupBy(*keys, "seg")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.sum("_rows").over(earlier) - F.col("_rows"))
        .drop("_rows")
    )
    in_range = Window.partitionBy(*keys, "seg").orderBy(*order)
    numbered = ranges.withColumn("_n", F.row_number().over(in_range))
    joined = numbered.join(offsets, [*keys, "seg"])
    return joined.withColumn(out, F.col("_offset") + F.col("_n")).select(*df.columns, out)
