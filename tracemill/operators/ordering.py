"""Order of events inside cases, also for cases that are too long for one task.

Ordinary cases are ordered by a window over the case. A case with more than ``hot_case_rows`` rows
is *hot*: its rows are range-partitioned by (case, order), every range is sorted and cut into segments of half as many
rows, and each segment is ordered on its own; the segments are joined up through a table with one row per case and
segment. Equal rows are counted before they move, so a group of copies never travels as rows.

In a log of traces every case lies in one row, in order, so nothing is grouped or sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.sources.eventlog import EventLog
from tracemill.storage import written

COPIES_PER_ROW = 10_000
#: Rows of hot cases that make a task of their own, where segments are shorter than that.
RANGE_ROWS = 500_000
#: Buckets that cases are counted in, and how many times finer than the longest possible cases they must be.
CASE_BUCKETS = 4096
FINER = 8


@dataclass
class SplitLog:
    """Events of ordinary cases, and the segments of hot ones (None when there are none)."""

    ordinary: DataFrame
    segments: DataFrame | None


def split_hot_cases(log: EventLog) -> SplitLog:
    """Find the hot cases."""
    if not hasattr(log, "_split"):
        log._split = _split(log)
    return log._split


def hot_cases(events: DataFrame, limit: int, buckets: int = CASE_BUCKETS) -> DataFrame | None:
    """(``case_id``, ``rows``) of the cases with more than ``limit`` rows, stored; None if there are none.

    Rows are counted per bucket of the case's hash first, a few numbers per task. No case has more rows than its bucket,
    so only those of buckets over the limit are counted one by one. Where the log is so long that most
    buckets would be, buckets are made finer first.
    """
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(buckets)).alias("bucket")
    sizes = events.groupBy(bucket).agg(F.count(F.lit(1)).alias("rows"))
    largest, total = sizes.agg(F.max("rows"), F.sum("rows")).first()
    if not total or largest <= limit:
        return None
    if (finer := FINER * (total // limit)) > buckets:
        return hot_cases(events, limit, finer)
    full = written(sizes.where(F.col("rows") > limit).select("bucket"), "buckets")  # total / limit of them at most
    some = events.select("case_id", bucket).join(full, "bucket", "left_semi")
    counts = some.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"))
    hot = written(counts.where(F.col("rows") > limit), "hot-cases")
    return None if hot.isEmpty() else hot


def _split(log: EventLog) -> SplitLog:
    limit = log.hot_case_rows
    hot = hot_cases(log.events, limit)
    if hot is None:
        return SplitLog(log.events, None)
    hot_rows = hot.agg(F.sum("rows")).first()[0]
    # The marks are stored, so Spark knows their size and broadcasts them only when they are few.
    ordinary = log.events.join(hot.select("case_id"), "case_id", "left_anti")
    hot_events = log.events.join(hot.select("case_id"), "case_id", "left_semi")
    runs = (
        hot_events.groupBy("case_id", *log.order_columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("chunk", F.explode(F.expr(f"sequence(0, (copies - 1) div {COPIES_PER_ROW})")))
        .withColumn("copies", F.expr(f"least({COPIES_PER_ROW}, copies - chunk * {COPIES_PER_ROW})"))
    )
    size = max(1, limit // 2)
    return SplitLog(ordinary, _segments(runs, ["case_id", *log.order, "chunk"], hot_rows, size))


def _segments(runs: DataFrame, order: list, rows: int, size: int) -> DataFrame:
    """``runs`` in ``order`` with the number of their segment, ``seg``, of ``size`` rows at most; stored.

    Ranges are found on a sample that goes to the driver, so there are only as many as tasks need; every task sorts its range
    and counts its rows off into segments.
    """
    ranges = max(2, math.ceil(rows / max(size, RANGE_ROWS)))
    place = F.monotonically_increasing_id()  # the range in the upper bits, the row of the range in the lower 33
    ranged = runs.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("seg", place)
    row = F.col("seg").bitwiseAND(F.lit((1 << 33) - 1))
    return written(ranged.withColumn("seg", F.col("seg") - row % size), "segments")


def range_segments(df: DataFrame, order: list, pieces: int | None = None) -> DataFrame:
    """Cut ``df`` into ranges of ``order`` and store it with the number of the range, ``seg``."""
    ranged = df.repartitionByRange(pieces, *order) if pieces else df.repartitionByRange(*order)
    return written(ranged.withColumn("seg", F.spark_partition_id()), "segments")


def ordered_events(log: EventLog) -> DataFrame:
    """Every event with its position in the case, from 1."""
    if log.rows is not None:
        placed = log.rows.select("case_id", F.posexplode("trace").alias("ts", "activity"))
        return placed.select("case_id", "ts", "activity", (F.col("ts") + 1).cast("long").alias("pos"))
    split = split_hot_cases(log)
    in_case = Window.partitionBy("case_id").orderBy(*log.order)
    ordinary = split.ordinary.withColumn("pos", F.row_number().over(in_case).cast("long"))
    if split.segments is None:
        return ordinary
    by_segment = Window.partitionBy("case_id").orderBy("seg")
    before_segment = (
        split.segments.groupBy("case_id", "seg")
        .agg(F.sum("copies").alias("rows"))
        .withColumn("offset", F.sum("rows").over(by_segment) - F.col("rows"))
        .select("case_id", "seg", "offset")
    )
    in_segment = Window.partitionBy("case_id", "seg").orderBy(*log.order, "chunk")
    upto = F.sum("copies").over(in_segment.rowsBetween(Window.unboundedPreceding, 0))
    hot = (
        split.segments.withColumn("upto", upto)
        .join(before_segment, ["case_id", "seg"])
        .withColumn("pos", F.explode(F.expr("sequence(offset + upto - copies + 1, offset + upto)")))
        .select(*ordinary.columns)
    )
    return ordinary.unionByName(hot)


def traces(log: EventLog, part_rows: int | None = None) -> DataFrame:
    """Ordered activities per case: ``case_id, trace``, one row per case.

    With ``part_rows``, ``case_id, part, trace``: part 0 has the first ``part_rows`` events of a
    case, part 1 the next, and so on. Ask for it where a whole case may not fit a row.
    """
    if part_rows is None:
        if log.rows is not None:
            return log.rows.where(F.size("trace") > 0)
        keys, parts = ["case_id"], []
    else:
        keys, parts = ["case_id", "part"], [F.expr(f"(pos - 1) div {part_rows}").alias("part")]
    return (
        ordered_events(log)
        .select("case_id", *parts, F.struct("pos", "activity").alias("event"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("event")).alias("events"))
        .select(*keys, F.transform("events", lambda e: e["activity"]).alias("trace"))
    )


def _row_steps(rows: DataFrame) -> DataFrame:
    """Steps inside each row: each activity beside the next, null before the first and after the last."""
    none = F.array(F.lit(None).cast("string"))
    zipped = F.arrays_zip(F.concat(none, "trace").alias("src"), F.concat("trace", none).alias("dst"))
    steps = rows.select(F.explode(zipped).alias("step")).select("step.src", "step.dst", F.lit(1).cast("long").alias("cnt"))
    # an empty trace gives one step without ends, told after the traces were taken apart rather than before and again
    return steps.where("src is not null or dst is not null")


def steps(log: EventLog) -> DataFrame:
    """Steps ``src, dst, cnt`` that are not summed up yet; src is null where a case starts, dst where it ends."""
    if log.rows is not None:
        return _row_steps(log.rows)
    split = split_hot_cases(log)
    in_case = Window.partitionBy("case_id").orderBy(*log.order)
    ordinary = split.ordinary.select(
        "activity",
        F.lead("activity").over(in_case).alias("dst"),
        F.lag("activity").over(in_case).isNull().alias("opens"),
    )
    onward, opening = _step("activity", "dst"), _step(None, "activity")
    ordinary = ordinary.select(F.inline(F.when(F.col("opens"), F.array(onward, opening)).otherwise(F.array(onward))))
    return ordinary if split.segments is None else ordinary.unionByName(_hot_steps(log, split.segments))


def _step(src: str | None, dst: str | Column, cnt: Column | None = None) -> Column:
    src = F.lit(None).cast("string") if src is None else F.col(src)
    dst = F.col(dst) if isinstance(dst, str) else dst
    cnt = F.lit(1) if cnt is None else cnt
    return F.struct(src.alias("src"), dst.alias("dst"), cnt.cast("long").alias("cnt"))


def _hot_steps(log: EventLog, segments: DataFrame) -> DataFrame:
    key = log.sort_key("chunk")
    by_segment = Window.partitionBy("case_id").orderBy("seg")
    seams = (
        segments.groupBy("case_id", "seg")
        .agg(F.min_by("activity", key).alias("first_activity"))
        .select(
            "case_id",
            "seg",
            F.lead("first_activity").over(by_segment).alias("after_segment"),
            F.lag("seg").over(by_segment).isNull().alias("opens_case"),
        )
    )
    in_segment = Window.partitionBy("case_id", "seg").orderBy(*log.order, "chunk")
    rows = segments.select(
        "case_id",
        "seg",
        "activity",
        "copies",
        F.lead("activity").over(in_segment).alias("next"),
        F.lag("activity").over(in_segment).isNull().alias("opens_segment"),
    ).join(seams, ["case_id", "seg"])
    onward = _step("activity", F.coalesce("next", "after_segment"))
    repeats = _step("activity", "activity", F.col("copies") - 1)
    opening = _step(None, "activity", F.col("opens_segment") & F.col("opens_case"))
    return rows.select(F.inline(F.array(onward, repeats, opening))).where("cnt > 0")
