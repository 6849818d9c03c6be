"""Event logs in text files."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.errors import DelimiterError, MissingColumnError
from tracemill.sources.eventlog import EventLog, _quoted

_HEAD_CHARS = 1024
_FILE, _BLOCK, _LINE = "_file", "_block", "_line"


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Guess the separator from the first 1024 characters."""
    head = spark.read.text(path).select(F.substring("value", 1, _HEAD_CHARS)).limit(_HEAD_CHARS // 2)
    text = ""
    for (line,) in head.toLocalIterator():
        text += line + "\n"
        if len(text) >= _HEAD_CHARS:
            break
    try:
        return csv.Sniffer().sniff(text[:_HEAD_CHARS]).delimiter
    except csv.Error as e:
        raise DelimiterError(f"no delimiter recognised in {path}: {e}") from e


def read_csv_table(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    schema: StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """All columns of a CSV file with a header; text columns unless ``schema`` says otherwise.

    ``multi_line`` allows line breaks inside quotes; such files cannot be split among tasks.
    """
    reader = spark.read.option("header", True).option("sep", sep or detect_delimiter(spark, path))
    reader = reader.option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_csv(
    spark: SparkSession,
    path: str,
    ts: str = "timestamp",
    case: str = "case",
    activity: str = "event",
    tie: tuple[str, ...] = (),
    sep: str | None = None,
    schema: StructType | str | None = None,
    multi_line: bool = False,
    **options,
) -> EventLog:
    """A CSV log. Events of a case with equal times keep file order unless ``tie`` is given: the files in the
    order of their paths, whatever their sizes, and the lines of each as they stand.

    Without a ``schema``, the time, tie, and case columns are read once to see whether they are
    numbers, so that they sort as numbers; with one, nothing is read ahead. The role columns
    are stored at their first use, so the text is taken apart once for everything else.
    """
    table = read_csv_table(spark, path, sep, schema, multi_line)
    missing = [c for c in (ts, case, activity, *tie) if c not in table.columns]
    if missing:
        raise MissingColumnError(f"no column {', '.join(missing)}; found {', '.join(table.columns)}")
    if schema is None:
        kinds = _column_types(table, case, [ts, *tie])
        table = table.withColumns({c: F.col(_quoted(c)).cast(kind) for c, kind in kinds.items()})
    if not tie:
        # Spark deals out files by size, so a row's place is its file, the split it came with, and, as a split is
        # read by one task from its start to its end, an id that grows within the task.
        places = {_FILE: F.input_file_name(), _BLOCK: F.input_file_block_start(), _LINE: F.monotonically_increasing_id()}
        table = table.withColumns(places)
        tie = (_FILE, _BLOCK, _LINE)
        if options.setdefault("store", True):
            options["ranked_tie"] = _FILE
    return EventLog(table, case=case, ts=ts, activity=activity, tie=tie, **{"store": True, **options})


# Text that is a number, and nothing that some parser merely takes for one (1d, 0x1, NaN).
_WHOLE = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_CASE_NUMBER = "^(0|-?[1-9][0-9]*)$"


def _column_types(table: DataFrame, case: str, ordered: list[str]) -> dict[str, str]:
    """Number types for the text columns of a log; columns that are no numbers are left out.

    A case becomes a whole number only when that keeps all ids apart: each is written the one
    usual way and fits. Times and ties become whole numbers, long ones as decimals, else doubles.
    """
    checks, choices = [], {}

    def check(column: str, name: str, fits) -> None:
        checks.append(F.coalesce(F.bool_and(F.col(_quoted(column)).isNull() | fits), F.lit(False)).alias(name))

    def text(column: str):
        return F.trim(F.col(_quoted(column)))

    for i, c in enumerate(dict.fromkeys(ordered)):
        whole = text(c).rlike(_WHOLE)
        choices[c] = [(f"{kind}_{i}", kind) for kind in ("bigint", "decimal(38,0)", "double")]
        check(c, f"bigint_{i}", whole & text(c).try_cast("bigint").isNotNull())
        check(c, f"decimal(38,0)_{i}", whole & text(c).try_cast("decimal(38,0)").isNotNull())
        check(c, f"double_{i}", text(c).rlike(_NUMBER))
    choices[case] = [("case", "bigint")]
    ids = F.col(_quoted(case))
    check(case, "case", ids.rlike(_CASE_NUMBER) & ids.try_cast("bigint").isNotNull())
    found = table.agg(*checks).first()
    types = {}
    for c, kinds in choices.items():
        types.update({c: kind for name, kind in reversed(kinds) if found[name]})
    return types


#: What stands after a backslash for a character that ends labels, parts, or lines.
ESCAPES = {",": "c", "\t": "t", "\n": "n", "\r": "r"}
#: The end of an escaped line, so that a label at its end, and an empty one, is not taken for blank space.
LINE_END = ";"


def unescaped(label: Column) -> Column:
    """A label as it was before :func:`tracemill.sinks.text.escaped`."""

    def undone(part: Column) -> Column:
        for char, sign in ESCAPES.items():
            part = F.replace(part, F.lit("\\" + sign), F.lit(char))
        return part

    # between escaped backslashes, a backslash begins another escape
    return F.array_join(F.transform(F.split(label, r"\\\\", -1), undone), "\\")


def _labels(line: Column) -> Column:
    return F.transform(F.split(F.substring(line, F.lit(1), F.length(line) - 1), ",", -1), unescaped)


def read_traces(
    spark: SparkSession, path: str, sep: str | None = ",", parts: bool = False, escaped: bool = False, **options
) -> EventLog:
    """One case per line; activities separated by ``sep``, or by white space when it is None.

    ``parts`` reads what ``write_traces`` wrote with ``part_rows``: the case, the number of the part,
    and the part, separated by tabs. ``escaped`` reads what it wrote with ``escape``; ``sep`` is then the comma.
    """
    if parts:
        split = F.split("value", "\t", 3)
        lines = spark.read.text(path).where("value <> ''").select(
            (unescaped(split[0]) if escaped else split[0]).alias("case"),
            split[1].cast("bigint").alias("part"),
            (_labels(split[2]) if escaped else F.split(split[2], ",")).alias("trace"),
        )
        events = lines.select("case", "part", F.posexplode("trace").alias("place", "event"))
        return EventLog(events, case="case", ts="part", tie=["place"], activity="event", **options)
    if escaped:
        lines = spark.read.text(path).where("value <> ''")
        return EventLog.from_traces(lines.select(_labels(F.col("value")).alias("trace")), **options)
    lines = spark.read.text(path).where(F.trim("value") != "")
    if sep is None:
        trace = F.split(F.trim("value"), r"\s+")
    else:
        literal = "".join("\\" + ch if not ch.isalnum() else ch for ch in sep)
        trace = F.split(F.rtrim(F.col("value")), literal)
    return EventLog.from_traces(lines.select(trace.alias("trace")), **options)
