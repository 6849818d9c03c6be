"""Text output: trace files and DOT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.graph import ProcessGraph
from tracemill.operators.ordering import traces
from tracemill.sources.eventlog import EventLog
from tracemill.sources.files import ESCAPES, LINE_END

# Shapes, styles, colours, and label words of the drawings.
ACTIVITY_SHAPE = "box"
ACTIVITY_STYLE = "rounded"
TERMINAL_SHAPE = "doublecircle"
CLUSTER_SHAPE = "octagon"
FILLED = "filled"
START_COLOUR = "green"
END_COLOUR = "red"
NODE_COLOUR = "#FDFFF5"
CLUSTER_COLOUR = "#6495ED"
CLUSTER_EDGE_COLOUR = "red"
SIGNIFICANCE_LABEL = '<%s<br/><font color="red">%s</font>>'
CLUSTER_LABEL = "Cluster %d\n%d Elements\n~%s"


def trace_lines(log: EventLog, part_rows: int | None = None, escape: bool = False) -> DataFrame:
    """Comma-joined lines, ``case_id, value`` or ``case_id, part, value`` (see ``traces``).

    ``escape`` writes commas, tabs, line ends and backslashes in labels as a backslash and a letter (a second backslash), and
    ends every line with a semicolon, so that any label comes back from ``read_traces(.., escaped=True)``.
    """
    found = traces(log, part_rows)
    trace = F.transform("trace", escaped) if escape else F.col("trace")
    line = F.array_join(trace, ",")
    if escape:
        line = F.concat(line, F.lit(LINE_END))
    return found.select(*found.columns[:-1], line.alias("value"))


def escaped(label: Column) -> Column:
    """``label`` without characters that end labels or lines; :func:`tracemill.sources.files.unescaped` undoes it."""
    label = F.replace(label, F.lit("\\"), F.lit("\\\\"))
    for char, sign in ESCAPES.items():
        label = F.replace(label, F.lit(char), F.lit("\\" + sign))
    return label


def write_traces(log: EventLog, path: str, part_rows: int | None = None, escape: bool = False) -> None:
    """One case per line under ``path``, as ``read_traces`` reads it.

    With ``part_rows``, for logs with cases that are too long for a line, every case is written in parts:
    the case, the number of the part, and the part, separated by tabs; ``read_traces(.., parts=True)``
    gives the same log. The layout is the caller's choice and never depends on the data. ``escape`` keeps labels (and, in
    parts, cases) apart that hold separators, for ``read_traces(.., escaped=True)``.
    """
    lines = trace_lines(log, part_rows, escape)
    if part_rows is not None:
        case = F.col("case_id").cast("string")
        lines = lines.select(F.concat_ws("\t", escaped(case) if escape else case, "part", "value").alias("value"))
    lines.select("value").write.text(path)


def _quoted(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def _html(text: Column) -> Column:
    """Text inside an HTML-like label."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return F.replace(text, F.lit("\n"), F.lit("<br/>"))


def _attributes(label: Column, **values: Column) -> Column:
    """`` [label=.. a="x" b="y"]`` without the attributes that are null; ``label`` is quoted already."""
    parts = [F.concat(F.lit("label="), label)]
    parts += [F.concat(F.lit(f"{k}="), _quoted(v.cast("string"))) for k, v in values.items()]
    return F.concat(F.lit(" ["), F.concat_ws(" ", *parts), F.lit("]"))


def _document(spark, statements: list[DataFrame]) -> DataFrame:
    """Rows ``section, key, line``; ordered by section and key they are the DOT text."""
    frame = spark.range(1).select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("section"), F.lit("").alias("key"), F.lit("digraph {").alias("line")),
                F.struct(F.lit(9).alias("section"), F.lit("").alias("key"), F.lit("}").alias("line")),
            )
        )
    )
    for i, s in enumerate(statements, start=1):
        frame = frame.unionByName(
            s.select(F.lit(i).alias("section"), F.col("key"), F.concat(F.lit("\t"), "line").alias("line"))
        )
    return frame


def _node_id(name: str, kind: str) -> Column:
    """``start``, ``end``, ``cluster:<leader>``, or the activity. Activities that look like one
    of these are marked, so that no two nodes share an id."""
    node = F.col(name)
    taken = node.isin("start", "end") | node.rlike("^(cluster|activity):")
    activity = F.when(taken, F.concat(F.lit("activity:"), node)).otherwise(node)
    return (
        F.when(F.col(kind) == "activity", activity)
        .when(F.col(kind) == "cluster", F.concat(F.lit("cluster:"), node))
        .otherwise(node)
    )


def heuristic_dot(graph: ProcessGraph) -> DataFrame:
    """DOT lines of a dependency graph."""
    kind = F.col("node_kind")
    terminal = kind != "activity"
    node = _quoted(_node_id("node", "node_kind"))
    style = _attributes(
        _quoted(F.col("label")),
        width=F.col("width"),
        height=F.col("height"),
        shape=F.when(terminal, TERMINAL_SHAPE).otherwise(ACTIVITY_SHAPE),
        style=F.when(terminal, FILLED).otherwise(ACTIVITY_STYLE),
        fillcolor=F.when(kind == "start", START_COLOUR).when(kind == "end", END_COLOUR),
    )
    nodes = graph.nodes.select(node.alias("key"), F.concat(node, style).alias("line"))
    return _document(graph.nodes.sparkSession, [nodes, _edges(graph, F.col("label"), None)])


def fuzzy_dot(graph: ProcessGraph) -> DataFrame:
    """DOT lines of a simplified graph."""
    cluster = F.col("node_kind") == "cluster"
    node = _quoted(_node_id("node", "node_kind"))
    sig = F.col("sig").cast("string")
    label = F.when(
        cluster, _quoted(F.format_string(CLUSTER_LABEL, "number", "size", sig))
    ).otherwise(F.format_string(SIGNIFICANCE_LABEL, _html(F.col("node")), sig))
    style = _attributes(
        label,
        width=F.col("width"),
        height=F.col("height"),
        shape=F.when(cluster, CLUSTER_SHAPE).otherwise(ACTIVITY_SHAPE),
        style=F.lit(FILLED),
        fillcolor=F.when(cluster, CLUSTER_COLOUR).otherwise(NODE_COLOUR),
    )
    nodes = graph.nodes.select(node.alias("key"), F.concat(node, style).alias("line"))
    at_cluster = (F.col("src_kind") == "cluster") | (F.col("dst_kind") == "cluster")
    colour = F.when(at_cluster, CLUSTER_EDGE_COLOUR)
    return _document(graph.nodes.sparkSession, [nodes, _edges(graph, F.col("value"), colour)])


def _edges(graph: ProcessGraph, label: Column, colour: Column | None) -> DataFrame:
    edge = F.concat(
        _quoted(_node_id("src", "src_kind")), F.lit(" -> "), _quoted(_node_id("dst", "dst_kind"))
    )
    attributes = {"penwidth": F.col("penwidth")}
    if colour is not None:
        attributes["color"] = colour
    return graph.edges.select(edge.alias("key"), F.concat(edge, _attributes(_quoted(label.cast("string")), **attributes)).alias("line"))


def write_dot(lines: DataFrame, path: str) -> None:
    """Write the lines in order; the files of the folder, in name order, are one DOT text."""
    lines.orderBy("section", "key").select("line").write.text(path)
