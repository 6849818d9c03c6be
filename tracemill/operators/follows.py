"""Counts over an event log: frequencies, directly-follows pairs, case starts and ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.blocks import block_ways
from tracemill.operators.ordering import steps
from tracemill.operators.ranking import ranked
from tracemill.sources.eventlog import EventLog
from tracemill.storage import written


def _activities(log: EventLog) -> DataFrame:
    """``activity``, a row per event."""
    if log.rows is not None:
        return log.rows.select(F.explode("trace").alias("activity"))
    return log.events.select("activity")


def activity_frequency(log: EventLog) -> DataFrame:
    """Events per activity: ``activity, freq``."""
    return _activities(log).groupBy("activity").agg(F.count(F.lit(1)).alias("freq"))


def max_frequency(stats: DataFrame) -> DataFrame:
    """One row with the largest frequency, the upper bound of a frequency filter."""
    return stats.agg(F.max("freq").alias("max_freq"))


def vocabulary(log: EventLog, by: str = "label") -> DataFrame:
    """Activities with their position from 1, by ``"label"`` or by ``"first_seen"``.

    First seen goes through the cases in case order, and through each case in time.
    """
    if by == "label":
        return ranked(_activities(log).distinct(), ["activity"], "position")
    if by != "first_seen":
        raise ValueError("by must be 'label' or 'first_seen'")
    first = F.min(F.struct(F.col("case_id"), log.sort_key())).alias("first")
    seen = log.events.groupBy("activity").agg(first)
    return ranked(seen, ["first"], "position").select("activity", "position")


def directly_follows(log: EventLog) -> DataFrame:
    """How often ``dst`` comes right after ``src`` in a case: ``src, dst, cnt``."""
    inner = steps(log).where("src is not null and dst is not null")
    return inner.groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


def start_activities(log: EventLog) -> DataFrame:
    """First activities with the number of cases they open: ``activity, cases``."""
    return _per_case(log, F.get("trace", F.lit(0)), lambda: F.min_by("activity", log.sort_key()))


def end_activities(log: EventLog) -> DataFrame:
    """Last activities with the number of cases they close: ``activity, cases``."""
    return _per_case(log, F.element_at("trace", -1), lambda: F.max_by("activity", log.sort_key()))


def _per_case(log: EventLog, of_row, of_events) -> DataFrame:
    if log.rows is not None:
        picked = log.rows.where(F.size("trace") > 0).select(of_row.alias("activity"))
    else:
        picked = log.events.groupBy("case_id").agg(of_events().alias("activity"))
    return picked.groupBy("activity").agg(F.count(F.lit(1)).alias("cases"))


@dataclass
class ProcessModel:
    """What both miners start from. ``miner`` and ``params`` are the miner and the settings that
    last drew a graph from it; they are kept on saving. A model that was loaded has ``pairs``: the pairs that
    occur, with their dependency and in its order, so that a threshold reads only what reaches it. One that was
    mined has ``ways``: both directions of a pair in one row, as :func:`both_ways` gives them. One that was mined from
    traces has ``totals``: the steps that leave each activity."""

    activities: DataFrame
    dfg: DataFrame
    starts: DataFrame
    ends: DataFrame
    params: dict[str, float] | None = None
    miner: str | None = None
    pairs: DataFrame | None = None
    ways: DataFrame | None = None
    totals: DataFrame | None = None


def both_ways(steps: DataFrame) -> DataFrame:
    """Steps counted by their two ends in label order: ``low, high, up, down``; a step without one end is an ``up``."""
    forward = F.coalesce(F.col("src") <= F.col("dst"), F.lit(True))
    zero = F.lit(0).cast("long")
    return (
        steps.select(
            F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("low"),
            F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("high"),
            F.when(forward, F.col("cnt")).otherwise(zero).alias("up"),
            F.when(forward, zero).otherwise(F.col("cnt")).alias("down"),
        )
        .groupBy("low", "high")
        .agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    )


def _counted(log: EventLog) -> DataFrame:
    """``both_ways`` of the steps of ``log``; of traces, with the totals of :func:`block_ways` in the rows without ``high``.

    Steps of traces come counted by blocks, so they are not counted again before they move; a pair has a row per block at
    most, so none weighs on the task it goes to. Pairs are one key, as Spark first tries plain ones in a small table that is
    of no use where most differ.
    """
    if log.rows is None:
        return both_ways(steps(log))
    dealt = block_ways(log.rows).select(F.struct("low", "high").alias("pair"), "up", "down").repartition("pair")
    summed = dealt.groupBy("pair").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return summed.select("pair.low", "pair.high", "up", "down")


def cell(src: str, dst: str, cnt: str, rev: str) -> Column:
    return F.struct(
        F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(cnt).alias("cnt"), F.col(rev).alias("rev")
    )


def occurring(ways: DataFrame) -> DataFrame:
    """``src, dst, cnt, rev`` of the directions that occur."""
    up, down = cell("low", "high", "up", "down"), cell("high", "low", "down", "up")
    itself = F.array(cell("low", "high", "up", "up"))
    cells = F.when(F.col("low") == F.col("high"), itself).when(F.col("down") == 0, F.array(up))
    return ways.select(F.inline(cells.when(F.col("up") == 0, F.array(down)).otherwise(F.array(up, down))))


def base_model(log: EventLog) -> ProcessModel:
    """Go through the log once and store its step counts; the rest is read off that table.

    Both directions of a pair are counted into one row, so whatever sets them against each other needs no second
    grouping. Every event is the source of one step (with no target at the end of its case), so
    frequencies, pairs, starts and ends are all sums over the same small table; of traces, frequencies lie in it.
    """
    counted = written(_counted(log), "steps")
    ways, totals = counted.where("low is not null and high is not null"), None
    if log.rows is None:
        edge = counted
        sources = occurring(counted.where("low is not null")).groupBy("src").agg(F.sum("cnt").alias("freq"))
        activities = sources.select(F.col("src").alias("activity"), "freq")
    else:
        edge = written(counted.where("low is null or high is null"), "totals")
        each = edge.where("high is null")
        activities = each.select(F.col("low").alias("activity"), F.col("down").alias("freq"))
        totals = each.where("down > up").select(F.col("low").alias("src"), (F.col("down") - F.col("up")).alias("total"))
    ending = edge.where("high is null and up > 0")
    return ProcessModel(
        activities=activities,
        dfg=occurring(ways).select("src", "dst", "cnt"),
        starts=edge.where("low is null").select(F.col("high").alias("activity"), F.col("up").alias("cases")),
        ends=ending.select(F.col("low").alias("activity"), F.col("up").alias("cases")),
        ways=ways,
        totals=totals,
    )
