"""The event log: a DataFrame with a case, an order, and an activity per row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.errors import MissingColumnError
from tracemill.storage import written

#: A case with more rows than this is ordered in several tasks.
HOT_CASE_ROWS = 5_000_000


class EventLog:
    """Role columns over any DataFrame.

    ``events`` holds only ``case_id, ts, tie_0.., activity``, so that scans read just those
    columns. ``case_id`` and ``ts`` keep their type (text times sort as text unless
    ``ts_format`` is given); the activity is a string. Rows without a case or an activity are
    left out; ``dropped_rows`` counts them.

    Events of a case are ordered by ``ts``, then the ``tie`` columns, then the activity, with
    missing values last. What is still equal after that is the same row, so any order of it
    gives the same result.

    Ordering goes through the rows twice: once to find cases that are too long for one task, once
    for the order. With ``store`` the role columns are written to the shared folder at their first
    use and read from there, which is worth it for text and for tables that are costly to compute.
    ``ranked_tie`` names a tie column of few long values (such as paths): of a stored log its values are
    replaced by their ranks, so that rows carry a number when they are shuffled.
    """

    def __init__(
        self,
        df: DataFrame,
        case: str = "case",
        ts: str = "timestamp",
        activity: str = "event",
        tie: Sequence[str] = (),
        ts_format: str | None = None,
        hot_case_rows: int = HOT_CASE_ROWS,
        store: bool = False,
        ranked_tie: str | None = None,
    ):
        missing = [c for c in (ts, case, activity, *tie) if c not in df.columns]
        if missing:
            raise MissingColumnError(f"no column {', '.join(missing)}; found {', '.join(df.columns)}")
        time = F.col(_quoted(ts))
        if ts_format is not None:
            time = F.to_timestamp(time, ts_format)
        self.source = df
        self.roles = {"case": case, "ts": ts, "activity": activity, "tie": list(tie)}
        self.hot_case_rows = hot_case_rows
        self.store = store
        self._ranked = f"tie_{list(tie).index(ranked_tie)}" if ranked_tie else None
        #: Of a log of traces: ``case_id, trace``, a whole case in each row.
        self.rows: DataFrame | None = None
        self.tie_columns = [f"tie_{i}" for i in range(len(tie))]
        self._roles = df.select(
            F.col(_quoted(case)).alias("case_id"),
            time.alias("ts"),
            *[F.col(_quoted(c)).alias(t) for c, t in zip(tie, self.tie_columns)],
            F.col(_quoted(activity)).cast("string").alias("activity"),
        ).where("case_id is not null and activity is not null")

    @cached_property
    def events(self) -> DataFrame:
        """``case_id, ts, tie_0.., activity``"""
        if not self.store:
            return self._roles
        stored = written(self._roles, "events")
        if self._ranked is None:
            return stored
        rank = F.row_number().over(Window.orderBy(self._ranked)).cast("long")  # over the few distinct values
        ranks = written(stored.select(self._ranked).distinct().withColumn("rank", rank), "ranks")
        return stored.join(ranks, self._ranked).withColumn(self._ranked, F.col("rank")).select(*stored.columns)

    @classmethod
    def from_positions(
        cls, df: DataFrame, ts: int = 0, activity: int = 1, case: int = 2, **options
    ) -> EventLog:
        """Roles by column position: time, event, case unless told otherwise."""
        highest = max(ts, activity, case)
        if highest >= len(df.columns):
            raise MissingColumnError(f"no column at position {highest}; found {len(df.columns)}")
        name = df.columns
        return cls(df, case=name[case], ts=name[ts], activity=name[activity], **options)

    @classmethod
    def from_traces(
        cls, df: DataFrame, trace: str = "trace", case: str | None = None, **options
    ) -> EventLog:
        """One row per case with an array of activities; empty arrays give no events.

        A case is one row, so steps, starts, and ends are read off each row where it lies; rows are
        cases of their own even if two share an id. Null activities are left out.
        """
        if trace not in df.columns:
            raise MissingColumnError(f"no column {trace}; found {', '.join(df.columns)}")
        case_id = F.col(_quoted(case)) if case else F.monotonically_increasing_id()
        one_per_case = df.select(case_id.alias("case"), F.col(_quoted(trace)).alias("trace"))
        events = one_per_case.select("case", F.posexplode("trace").alias("timestamp", "event"))
        log = cls(events, **options)
        activities = F.col("trace").cast("array<string>")
        if df.schema[trace].dataType.containsNull:  # of a split text, say, there is nothing to leave out
            activities = F.filter(activities, lambda a: a.isNotNull())
        log.rows = one_per_case.where("case is not null").select(
            F.col("case").alias("case_id"), activities.alias("trace")
        )
        return log

    @property
    def order_columns(self) -> list[str]:
        return ["ts", *self.tie_columns, "activity"]

    @property
    def order(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in self.order_columns]

    def sort_key(self, *more: str) -> Column:
        """The order of ``order`` as one comparable value (for min, max, min_by, max_by)."""
        parts = []
        for c in (*self.order_columns, *more):
            parts += [F.col(c).isNull(), F.col(c)]
        return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])

    def dropped_rows(self) -> DataFrame:
        """One row: rows without a case, and rows with a case but without an activity."""
        no_case = F.col(_quoted(self.roles["case"])).isNull()
        no_activity = F.col(_quoted(self.roles["activity"])).isNull()
        return self.source.agg(
            F.count_if(no_case).alias("without_case"),
            F.count_if(~no_case & no_activity).alias("without_activity"),
        )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
