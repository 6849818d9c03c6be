"""Queries over the given tables, one or more per operator, and the same results in SQL.

Logs (case / order / activity):

* ``events``         user_id / ts, event_id / event_type
* ``banded``         the same with the event type split into four bands of ``value``
* ``orders``         o_custkey / o_orderdate, o_orderkey / o_orderpriority
* ``conversations``  conv_id / turn / role
* ``lineitem``       l_orderkey / l_shipdate, l_linenumber, l_partkey, l_suppkey / flag and status
* ``words``          doc_id / position / word of ``documents``
* ``long_cases``     l_returnflag / l_shipdate, l_orderkey, .. / line status and number: three
  cases, each too long for one task by the limit it is given here
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tracemill as tm
from tracemill.functions import fmt2, np2
from tracemill.operators.leaders import clusters
from tracemill.operators.ranking import ranked
from tracemill.storage import new_dir, written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def _query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql is not None:
        _ORACLE[name] = sql


# -- logs -----------------------------------------------------------------------

_BANDED = """event_type || '_' || CASE WHEN value <= 5 THEN 'xs' WHEN value <= 20 THEN 's'
    WHEN value <= 60 THEN 'm' ELSE 'l' END"""
_ROLES = {
    "events": ("events", "user_id", ["ts", "event_id"], "event_type"),
    "banded": ("events", "user_id", ["ts", "event_id"], _BANDED),
    "orders": ("orders", "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority"),
    "conversations": ("conversations", "conv_id", ["turn"], "role"),
    "lineitem": (
        "lineitem", "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"],
        "l_returnflag || l_linestatus",
    ),
    "long_cases": (
        "lineitem", "l_returnflag",
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        "l_linestatus || '_' || l_linenumber",
    ),
}
LOGS = ("events", "banded", "orders", "conversations", "lineitem", "words")
_LONG_CASE_ROWS = 5_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str, name: str) -> tm.EventLog:
    if name == "words":
        docs = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("trace"))
        return tm.EventLog.from_traces(docs, case="doc_id")
    table, case, (ts, *tie), activity = _ROLES[name]
    df = _table(spark, sf_dir, table).withColumn("activity", F.expr(activity))
    options = {"hot_case_rows": _LONG_CASE_ROWS} if name == "long_cases" else {}
    return tm.EventLog(df, case=case, ts=ts, tie=tie, activity="activity", **options)


def _model(spark: SparkSession, sf_dir: str, name: str) -> tm.ProcessModel:
    return tm.base_model(_log(spark, sf_dir, name))


def _sql_log(name: str) -> str:
    """CTEs ``log, ord, stats, dfg, starts, ends`` of a log."""
    if name == "words":
        log = """SELECT doc_id AS case_id, unnest(string_split(text, ' ')) AS activity,
            generate_subscripts(string_split(text, ' '), 1) AS o1 FROM documents"""
        order = "o1"
    else:
        table, case, keys, activity = _ROLES[name]
        sort = ", ".join(f"{k} AS o{i}" for i, k in enumerate(keys, 1))
        log = f"SELECT {case} AS case_id, {activity} AS activity, {sort} FROM {table}"
        order = ", ".join(f"o{i}" for i in range(1, len(keys) + 1))
    return f"""WITH RECURSIVE log AS ({log}),
    ord AS (SELECT *, row_number() OVER w AS pos, lead(activity) OVER w AS nxt,
        lag(activity) OVER w AS prv FROM log WINDOW w AS (PARTITION BY case_id ORDER BY {order})),
    stats AS (SELECT activity, count(*) AS freq FROM log GROUP BY activity),
    dfg AS (SELECT activity AS src, nxt AS dst, count(*) AS cnt FROM ord
        WHERE nxt IS NOT NULL GROUP BY ALL),
    starts AS (SELECT activity, count(*) AS cases FROM ord WHERE prv IS NULL GROUP BY activity),
    ends AS (SELECT activity, count(*) AS cases FROM ord WHERE nxt IS NULL GROUP BY activity)
    """


# -- log shaping and base counts ---------------------------------------------------

for _name in LOGS:
    _query(
        f"directly_follows_{_name}",
        lambda s, d, n=_name: tm.directly_follows(_log(s, d, n)),
        _sql_log(_name) + "SELECT src, dst, cnt FROM dfg",
    )
    _query(
        f"activity_frequency_{_name}",
        lambda s, d, n=_name: tm.activity_frequency(_log(s, d, n)),
        _sql_log(_name) + "SELECT activity, freq FROM stats",
    )
    _query(
        f"start_activities_{_name}",
        lambda s, d, n=_name: tm.start_activities(_log(s, d, n)),
        _sql_log(_name) + "SELECT activity, cases FROM starts",
    )
    _query(
        f"end_activities_{_name}",
        lambda s, d, n=_name: tm.end_activities(_log(s, d, n)),
        _sql_log(_name) + "SELECT activity, cases FROM ends",
    )
    _query(
        f"vocabulary_by_label_{_name}",
        lambda s, d, n=_name: tm.vocabulary(_log(s, d, n)),
        _sql_log(_name) + "SELECT activity, row_number() OVER (ORDER BY activity) AS position FROM stats",
    )
    _query(
        f"vocabulary_by_first_seen_{_name}",
        lambda s, d, n=_name: tm.vocabulary(_log(s, d, n), "first_seen"),
        _sql_log(_name) + """SELECT activity, row_number() OVER (ORDER BY case_id, pos) AS position
            FROM (SELECT DISTINCT ON (activity) activity, case_id, pos FROM ord
                  ORDER BY activity, case_id, pos)""",
    )

for _name in ("events", "orders", "lineitem", "conversations"):
    _query(
        f"ordered_events_{_name}",
        lambda s, d, n=_name: tm.ordered_events(_log(s, d, n)).select("case_id", "pos", "activity"),
        _sql_log(_name) + "SELECT case_id, pos, activity FROM ord",
    )
    _query(
        f"traces_{_name}",
        lambda s, d, n=_name: tm.trace_lines(_log(s, d, n), part_rows=100_000),
        _sql_log(_name) + """SELECT case_id, (pos - 1) // 100000 AS part,
            string_agg(activity, ',' ORDER BY pos) AS value FROM ord GROUP BY ALL""",
    )

for _what, _pick, _sql in (
    ("directly_follows", tm.directly_follows, "SELECT src, dst, cnt FROM dfg"),
    ("start_activities", lambda log: tm.base_model(log).starts, "SELECT activity, cases FROM starts"),
    ("end_activities", lambda log: tm.base_model(log).ends, "SELECT activity, cases FROM ends"),
    (
        "ordered_events",
        lambda log: tm.ordered_events(log).select("case_id", "pos", "activity"),
        "SELECT case_id, pos, activity FROM ord",
    ),
):
    _query(
        f"{_what}_long_cases",
        lambda s, d, p=_pick: p(_log(s, d, "long_cases")),
        _sql_log("long_cases") + _sql,
    )
_query(
    "ordered_events_words",
    lambda s, d: tm.ordered_events(_log(s, d, "words")).select("case_id", "pos", "activity"),
    _sql_log("words") + "SELECT case_id, pos, activity FROM ord",
)
_query(
    "max_frequency_words",
    lambda s, d: tm.max_frequency(tm.activity_frequency(_log(s, d, "words"))),
    _sql_log("words") + "SELECT max(freq) AS max_freq FROM stats",
)
_query(
    "dropped_rows_events",
    lambda s, d: _log(s, d, "events").dropped_rows(),
    """SELECT count(*) FILTER (user_id IS NULL) AS without_case,
        count(*) FILTER (user_id IS NOT NULL AND event_type IS NULL) AS without_activity FROM events""",
)


# -- sources and sinks -----------------------------------------------------------

def _csv_log(sep: str):
    """The conversations as a CSV log that is read back, its separator guessed."""

    def run(spark, sf_dir):
        path = new_dir(spark, "csv-log")
        turns = _table(spark, sf_dir, "conversations").select("turn", "role", "conv_id")
        turns.write.option("header", True).option("sep", sep).csv(path)
        log = tm.read_csv(spark, path, ts="turn", case="conv_id", activity="role")
        return tm.directly_follows(log)

    return run


_CONVERSATION_STEPS = _sql_log("conversations") + "SELECT src, dst, cnt FROM dfg"


def _csv_of(table: str, roles: dict[str, str], **options):
    """Role columns of a table as CSV text, read back as a log."""

    def run(spark, sf_dir):
        path = new_dir(spark, "csv-log")
        columns = [F.expr(e).alias(name) for name, e in roles.items()]
        _table(spark, sf_dir, table).select(*columns).write.option("header", True).csv(path)
        return tm.directly_follows(tm.read_csv(spark, path, sep=",", **options))

    return run


def _csv_folder(spark, sf_dir):
    """The events in three folders, the later the larger, all at one time: names order the files, not sizes."""
    path = new_dir(spark, "csv-log")
    part = F.expr("CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END")
    events = _table(spark, sf_dir, "events").select(
        "event_id", part.alias("part"), F.lit("t").alias("timestamp"), F.col("event_type").alias("event"),
        F.col("user_id").alias("case"),
    )
    for folder in range(3):
        own = events.where(F.col("part") == folder).repartitionByRange("event_id").sortWithinPartitions("event_id")
        own.select("timestamp", "event", "case").write.option("header", True).csv(f"{path}/{folder}")
    return tm.directly_follows(tm.read_csv(spark, f"{path}/*", sep=","))


_query(
    "csv_log_folder",
    _csv_folder,
    """WITH ord AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY
        CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END, event_id) AS dst FROM events)
        SELECT src, dst, count(*) AS cnt FROM ord WHERE dst IS NOT NULL GROUP BY ALL""",
)
def _escaped_traces(spark, sf_dir):
    """Orders whose labels end in separators, written as lines and read back."""
    path = new_dir(spark, "escaped-traces")
    odd = F.expr("element_at(array(',', '\\t', '\\n', '\\\\', ''), CAST(o_orderkey % 5 AS INT) + 1)")
    orders = _table(spark, sf_dir, "orders").withColumn("label", F.concat("o_orderpriority", odd))
    log = tm.EventLog(orders, case="o_custkey", ts="o_orderdate", activity="label", tie=["o_orderkey"])
    tm.write_traces(log, path, escape=True)
    return tm.directly_follows(tm.read_traces(spark, path, escaped=True))


_query(
    "escaped_traces_orders",
    _escaped_traces,
    """WITH odd AS (SELECT *, o_orderpriority || [',', chr(9), chr(10), chr(92), ''][(o_orderkey % 5 + 1)::INT] AS label
            FROM orders),
        ord AS (SELECT label AS src, lead(label) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM odd)
        SELECT src, dst, count(*) AS cnt FROM ord WHERE dst IS NOT NULL GROUP BY ALL""",
)
# Case ids of 21 digits that a double cannot tell apart.
_query(
    "csv_log_long_ids",
    _csv_of("events", {
        "timestamp": "event_id", "event": "event_type",
        "case": "concat('123456789012345', lpad(cast(user_id as string), 6, '0'))",
    }),
    """WITH ord AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst
        FROM events) SELECT src, dst, count(*) AS cnt FROM ord WHERE dst IS NOT NULL GROUP BY ALL""",
)
# Case ids with a letter that some number parsers take for a type.
_query(
    "csv_log_suffix_ids",
    _csv_of("events", {
        "timestamp": "event_id", "event": "event_type",
        "case": "concat(cast(user_id as string), if(value > 20, 'd', 'f'))",
    }),
    """WITH ord AS (SELECT event_type AS src,
        lead(event_type) OVER (PARTITION BY user_id, coalesce(value > 20, false) ORDER BY event_id) AS dst FROM events)
        SELECT src, dst, count(*) AS cnt FROM ord WHERE dst IS NOT NULL GROUP BY ALL""",
)
# Line numbers of two digits in a tie column: 2 comes before 10.
_query(
    "csv_log_text_ties",
    _csv_of(
        "events",
        {"timestamp": "0", "event": "event_type", "case": "user_id", "seq": "event_id"}, tie=("seq",),
    ),
    """WITH ord AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst
        FROM events) SELECT src, dst, count(*) AS cnt FROM ord WHERE dst IS NOT NULL GROUP BY ALL""",
)
_query("csv_log_comma", _csv_log(","), _CONVERSATION_STEPS)
_query("csv_log_semicolon_detected", _csv_log(";"), _CONVERSATION_STEPS)


def _positional_roles(spark, sf_dir):
    table = _table(spark, sf_dir, "events").select("ts", "event_type", "user_id", "event_id")
    return tm.directly_follows(tm.EventLog.from_positions(table, tie=["event_id"]))


_query("positional_roles_events", _positional_roles, _sql_log("events") + "SELECT src, dst, cnt FROM dfg")


def _trace_file(sep: str | None):
    def run(spark, sf_dir):
        path = new_dir(spark, "trace-file")
        log = _log(spark, sf_dir, "conversations")
        if sep == ",":
            tm.write_traces(log, path)
        else:
            lines = tm.traces(log).select(F.array_join("trace", " ").alias("value"))
            lines.write.text(path)
        return tm.directly_follows(tm.read_traces(spark, path, sep=sep))

    return run


_query("trace_file_comma", _trace_file(","), _CONVERSATION_STEPS)
_query("trace_file_white_space", _trace_file(None), _CONVERSATION_STEPS)


def _long_cases_round_trip(spark, sf_dir):
    path = new_dir(spark, "trace-file")
    tm.write_traces(_log(spark, sf_dir, "long_cases"), path, part_rows=100)
    return tm.directly_follows(tm.read_traces(spark, path, parts=True))


_query(
    "trace_file_long_cases_round_trip",
    _long_cases_round_trip,
    _sql_log("long_cases") + "SELECT src, dst, cnt FROM dfg",
)


def _written_trace_lines(spark, sf_dir):
    path = new_dir(spark, "trace-file")
    tm.write_traces(_log(spark, sf_dir, "orders"), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("cases"))


_query(
    "written_trace_lines_orders",
    _written_trace_lines,
    _sql_log("orders") + """SELECT value, count(*) AS cases FROM (
        SELECT case_id, string_agg(activity, ',' ORDER BY pos) AS value FROM ord GROUP BY case_id)
        GROUP BY value""",
)


def _saved_model(spark, sf_dir):
    path = new_dir(spark, "model")
    model = _model(spark, sf_dir, "banded")
    tm.heuristic_graph(model, 0.02, 20)  # the model remembers the settings
    tm.save_model(model, path)
    back = tm.load_model(spark, path)
    p = back.params
    edges = tm.dependency_edges(back, p["dependency"], int(p["min_frequency"]))
    starts = back.starts.select(F.lit("start").alias("src"), F.col("activity").alias("dst"), F.col("cases").alias("cnt"))
    ends = back.ends.select(F.col("activity").alias("src"), F.lit("end").alias("dst"), F.col("cases").alias("cnt"))
    freq = back.activities.select(F.col("activity").alias("src"), F.lit("").alias("dst"), F.col("freq").alias("cnt"))
    return edges.select("src", "dst", "cnt").unionByName(starts).unionByName(ends).unionByName(freq)


_SQL_DEP = """, ways AS (SELECT src, dst, cnt, 0 AS rev FROM dfg UNION ALL SELECT dst, src, 0, cnt FROM dfg),
    cells AS (SELECT src, dst, sum(cnt)::BIGINT AS cnt, sum(rev)::BIGINT AS rev FROM ways GROUP BY src, dst),
    dep AS (SELECT src, dst, cnt,
        CASE WHEN src = dst THEN cnt / (cnt + 1) ELSE (cnt - rev) / (cnt + rev + 1) END AS dependency
        FROM cells WHERE cnt > 0)
    """
_query(
    "saved_model_read_back",
    _saved_model,
    _sql_log("banded") + _SQL_DEP + """SELECT src, dst, cnt FROM dep
        WHERE dependency >= 0.02::DOUBLE AND cnt >= 20
        UNION ALL SELECT 'start', activity, cases FROM starts
        UNION ALL SELECT activity, 'end', cases FROM ends
        UNION ALL SELECT activity, '', freq FROM stats""",
)


# -- bands in SQL --------------------------------------------------------------------

_BOUNDARIES = ", ".join(f"({i}, {0.1 + i * 0.39 / 19!r}::DOUBLE)" for i in range(20))


def _sql_bands(name: str, histogram: str) -> str:
    """CTE ``<name>(v, band)`` of a query with columns ``v, w``: values and how often they count.

    The rounds of the banding, one after the other. ``<name>_state<k>`` is what is left before round k, the
    candidates are the values near either end, and the best one goes. Up to eight values need no rounds.
    """
    text = f""", {name}_h AS (SELECT v::DOUBLE AS v, sum(w)::DOUBLE AS w FROM ({histogram}) GROUP BY 1),
    {name}_edges(i, b) AS (VALUES {_BOUNDARIES}),
    {name}_state0 AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, NULL::DOUBLE AS cut FROM {name}_h)"""
    for k in range(7):
        left = 8 - k
        text += f""",
    {name}_x{k} AS MATERIALIZED (SELECT v, w, (v - lo) / nullif(hi - lo, 0) AS x, lo, hi, n
        FROM {name}_h, {name}_state{k} WHERE v BETWEEN lo AND hi),
    {name}_sets{k} AS (SELECT side, i, sum(w) AS weight, count(*) AS taken, any_value(n) AS n,
        round(sqrt(greatest(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2, 0)), 9) AS spread,
        min(v) AS least, max(v) AS most
        FROM {name}_x{k}, {name}_edges, (VALUES (0), (1)) s(side)
        WHERE CASE side WHEN 0 THEN x <= b ELSE 1 - x <= b END GROUP BY side, i),
    {name}_fit{k} AS (SELECT *, abs(weight - share) / share AS off
        FROM {name}_sets{k}, (SELECT sum(w) / {left} AS share FROM {name}_x{k}) WHERE taken <= n - {left - 1}),
    {name}_best{k} AS (SELECT * FROM {name}_fit{k}
        WHERE off <= 0.45::DOUBLE + 0.5 * greatest(0, ceil(((SELECT min(off) FROM {name}_fit{k}) - 0.45::DOUBLE) / 0.5))
        ORDER BY round_even(off, 1), spread, side, i LIMIT 1),
    {name}_state{k + 1} AS (SELECT
        CASE WHEN side = 1 THEN s.lo ELSE (SELECT min(v) FROM {name}_x{k} WHERE v > coalesce(b.most, s.lo)) END AS lo,
        CASE WHEN side = 1 THEN (SELECT max(v) FROM {name}_x{k} WHERE v < b.least) ELSE s.hi END AS hi,
        s.n - coalesce(b.taken, 1) AS n,
        CASE WHEN side = 1 THEN b.least
            ELSE (SELECT min(v) FROM {name}_x{k} WHERE v > coalesce(b.most, s.lo)) END AS cut
        FROM {name}_state{k} s LEFT JOIN {name}_best{k} b ON true)"""
    cuts = " UNION ALL ".join(f"SELECT cut FROM {name}_state{k + 1}" for k in range(7))
    return text + f""",
    {name}_cuts AS MATERIALIZED (SELECT list(cut) AS cuts FROM ({cuts})),
    {name} AS (SELECT v, CASE WHEN (SELECT count(*) FROM {name}_h) <= 8 THEN (dense_rank() OVER (ORDER BY v) - 1)::DOUBLE
        ELSE len(list_filter(cuts, lambda c: c <= v))::DOUBLE END AS band FROM {name}_h, {name}_cuts)"""


# -- heuristic miner ---------------------------------------------------------------

for _name in LOGS:
    _query(
        f"dependencies_{_name}",
        lambda s, d, n=_name: tm.dependencies(_model(s, d, n)),
        _sql_log(_name) + _SQL_DEP + "SELECT src, dst, cnt, dependency FROM dep",
    )

for _name, _theta, _freq in (
    ("events", 0.02, 20), ("conversations", 0.5, 1), ("conversations", 0.1, 1),
    ("lineitem", 0.0, 1), ("lineitem", 0.1, 50), ("banded", 0.2, 10), ("words", 0.9, 5),
):
    _query(
        f"dependency_edges_{_name}_{str(_theta).replace('.', '')}_{_freq}",
        lambda s, d, n=_name, t=_theta, f=_freq: tm.dependency_edges(_model(s, d, n), t, f),
        _sql_log(_name) + _SQL_DEP + f"""SELECT src, dst, cnt, dependency FROM dep
            WHERE dependency >= {_theta}::DOUBLE AND cnt >= {_freq}""",
    )

_SQL_DENSE = """, dense AS (SELECT x.activity AS src, y.activity AS dst,
    coalesce(f.cnt, 0) AS cnt, coalesce(r.cnt, 0) AS rev
    FROM stats x CROSS JOIN stats y
    LEFT JOIN dfg f ON f.src = x.activity AND f.dst = y.activity
    LEFT JOIN dfg r ON r.src = y.activity AND r.dst = x.activity)
    """
for _name in ("events", "banded", "conversations", "lineitem"):
    _query(
        f"dependency_cells_{_name}",
        lambda s, d, n=_name: tm.dependency_cells(_model(s, d, n)),
        _sql_log(_name) + _SQL_DENSE + """SELECT src, dst, cnt, rev,
            CASE WHEN src = dst THEN cnt / (cnt + 1) ELSE (cnt - rev) / (cnt + rev + 1) END AS dependency
            FROM dense WHERE cnt > 0 OR rev > 0""",
    )
    _query(
        f"dependency_zero_cells_{_name}",
        lambda s, d, n=_name: tm.zero_cells(_model(s, d, n)),
        _sql_log(_name) + _SQL_DENSE + """SELECT src, count(*) FILTER (cnt = 0 AND rev = 0) AS zero_cells
            FROM dense GROUP BY src""",
    )

_SQL_TERMINAL = """SELECT 'start' AS src, 'start' AS src_kind, activity AS dst, 'activity' AS dst_kind,
    'start' AS kind, cases AS cnt FROM starts
    UNION ALL SELECT activity, 'activity', 'end', 'end', 'end', cases FROM ends"""
_query(
    "terminal_edges_lineitem",
    lambda s, d: tm.terminal_edges(_model(s, d, "lineitem")),
    _sql_log("lineitem") + _SQL_TERMINAL,
)


def _sql_heuristic_edges(name: str, theta: float, freq: int) -> str:
    """CTE ``edges`` of a heuristic graph."""
    return _sql_log(name) + _SQL_DEP + f""", edges AS (
        SELECT src, 'activity' AS src_kind, dst, 'activity' AS dst_kind, 'mined' AS kind, cnt,
            dependency, cast(cnt AS VARCHAR) AS label FROM dep
            WHERE dependency >= {theta}::DOUBLE AND cnt >= {freq}
        UNION ALL SELECT *, NULL, NULL FROM ({_SQL_TERMINAL})),
        nodes AS (SELECT activity AS node, 'activity' AS node_kind, freq,
            activity || chr(10) || freq AS label FROM stats
            UNION ALL SELECT * FROM (VALUES ('start', 'start', NULL, 'start'), ('end', 'end', NULL, 'end')))
        """


for _name, _theta, _freq in (("conversations", 0.5, 1), ("lineitem", 0.1, 1), ("events", 0.02, 20), ("words", 0.5, 2)):
    _tag = f"{_name}_{str(_theta).replace('.', '')}_{_freq}"
    _query(
        f"heuristic_graph_edges_{_tag}",
        lambda s, d, n=_name, t=_theta, f=_freq: tm.heuristic_graph(_model(s, d, n), t, f, sizes=False).edges,
        _sql_heuristic_edges(_name, _theta, _freq) + "SELECT * FROM edges",
    )
    _query(
        f"heuristic_graph_nodes_{_tag}",
        lambda s, d, n=_name, t=_theta, f=_freq: tm.heuristic_graph(_model(s, d, n), t, f, sizes=False).nodes,
        _sql_heuristic_edges(_name, _theta, _freq) + "SELECT * FROM nodes",
    )

_SQL_SIZED = (
    _sql_bands("freqs", "SELECT freq AS v, 1 AS w FROM stats")
    + _sql_bands("deps", """SELECT DISTINCT dependency AS v, 1 AS w FROM (SELECT dependency FROM dep WHERE dependency >= 0
        UNION ALL SELECT (cnt - rev) / (cnt + rev + 1) FROM cells WHERE src <> dst AND cnt >= rev
        UNION ALL SELECT 0.0::DOUBLE WHERE (SELECT count(*) FROM stats) ** 2 > (SELECT count(*) FROM cells))""")
    + """, sized_nodes AS (SELECT activity AS node, 'activity' AS node_kind,
        activity || chr(10) || freq AS label, freq, band / 2 + 1.5::DOUBLE AS width,
        (band / 2 + 1.5::DOUBLE) / 3 AS height FROM stats JOIN freqs ON v = freq
        UNION ALL SELECT * FROM (VALUES ('start', 'start', 'start', NULL, NULL, NULL),
            ('end', 'end', 'end', NULL, NULL, NULL))),
    sized_edges AS (SELECT e.*, coalesce(band + 1, 0.1::DOUBLE) AS penwidth
        FROM edges e LEFT JOIN deps ON v = e.dependency)
    """
)
_SIZED = _sql_heuristic_edges("conversations", 0.1, 1) + _SQL_SIZED
_SQL_HEURISTIC_DOT = r"""SELECT 0 AS section, '' AS key, 'digraph {' AS line UNION ALL SELECT 9, '', '}'
        UNION ALL SELECT 1, '"' || node || '"', chr(9) || '"' || node || '" [label="' || CASE
            WHEN node_kind = 'activity' THEN node || '\n' || freq || '" width="' || width || '" height="' || height
                || '" shape="box" style="rounded"]'
            ELSE node || '" shape="doublecircle" style="filled" fillcolor="'
                || CASE node WHEN 'start' THEN 'green' ELSE 'red' END || '"]' END FROM sized_nodes
        UNION ALL SELECT 2, '"' || src || '" -> "' || dst || '"', chr(9) || '"' || src || '" -> "' || dst || '" ['
            || coalesce('label="' || label || '" ', '') || 'penwidth="' || penwidth || '"]' FROM sized_edges"""


for _name, _theta, _freq in (("words", 0.5, 2), ("lineitem", 0.02, 1), ("banded", 0.2, 1)):
    for _half in ("nodes", "edges"):
        _query(
            f"heuristic_graph_sized_{_half}_{_name}",
            lambda s, d, n=_name, t=_theta, f=_freq, h=_half: getattr(tm.heuristic_graph(_model(s, d, n), t, f), h),
            _sql_heuristic_edges(_name, _theta, _freq) + _SQL_SIZED + f"SELECT * FROM sized_{_half}",
        )


def _sized_graph(spark, sf_dir):
    return tm.heuristic_graph(_model(spark, sf_dir, "conversations"), 0.1, 1)


_query(
    "heuristic_graph_sized_nodes_conversations",
    lambda s, d: _sized_graph(s, d).nodes,
    _SIZED + "SELECT * FROM sized_nodes",
)
_query(
    "heuristic_graph_sized_edges_conversations",
    lambda s, d: _sized_graph(s, d).edges,
    _SIZED + "SELECT * FROM sized_edges",
)
_query(
    "heuristic_dot_conversations",
    lambda s, d: tm.heuristic_dot(_sized_graph(s, d)),
    _SIZED + _SQL_HEURISTIC_DOT,
)
_query(
    "heuristic_dot_lineitem",
    lambda s, d: tm.heuristic_dot(tm.heuristic_graph(_model(s, d, "lineitem"), 0.02, 1)),
    _sql_heuristic_edges("lineitem", 0.02, 1) + _SQL_SIZED + _SQL_HEURISTIC_DOT,
)

_THRESHOLDS = [tm.HeuristicParams(i / 100, 1) for i in range(101)]
_SQL_THRESHOLDS = ", ".join(f"({i}, {i / 100}::DOUBLE, 1)" for i in range(101))
for _name in ("lineitem", "conversations", "banded"):
    _query(
        f"heuristic_sweep_{_name}",
        lambda s, d, n=_name: tm.heuristic_sweep(_model(s, d, n), _THRESHOLDS),
        _sql_log(_name) + _SQL_DEP + f""", params(param_id, threshold, min_frequency) AS
            (VALUES {_SQL_THRESHOLDS})
            SELECT param_id::BIGINT AS param_id, threshold, min_frequency::BIGINT AS min_frequency,
                src, dst, cnt, dependency
            FROM params JOIN dep ON dependency >= threshold AND cnt >= min_frequency""",
    )


def _saved_sweep(spark, sf_dir):
    path = new_dir(spark, "model")
    tm.save_model(_model(spark, sf_dir, "words"), path)
    return tm.heuristic_sweep(tm.load_model(spark, path), [tm.HeuristicParams(t, 2) for t in (0.6, 0.75, 0.9)])


_query(
    "heuristic_sweep_saved_words",
    _saved_sweep,
    _sql_log("words") + _SQL_DEP + """, params(param_id, threshold, min_frequency) AS
        (VALUES (0, 0.6::DOUBLE, 2), (1, 0.75::DOUBLE, 2), (2, 0.9::DOUBLE, 2))
        SELECT param_id::BIGINT AS param_id, threshold, min_frequency::BIGINT AS min_frequency,
            src, dst, cnt, dependency
        FROM params JOIN dep ON dependency >= threshold AND cnt >= min_frequency""",
)


# -- fuzzy miner -------------------------------------------------------------------

MAIN = (0.3, 0.1, 0.4, 0.5)
GRID = [
    (0.0, 0.0, 0.0, 0.0), MAIN, (0.5, 0.2, 0.0, 0.0), (0.3, 0.2, 0.4, 0.5), (0.9, 0.05, 0.1, 0.9),
    (0.4, 0.0, 0.5, 0.25), (1.0, 0.12, 0.2, 0.0), (0.6, 0.15, 0.0, 1.0), (1.0, 1.0, 1.0, 1.0),
]


def _sql_fuzzy(name: str, params: list[tuple]) -> str:
    """CTEs of the whole miner on all pairs of activities, per setting."""
    values = ", ".join(
        f"({i}::BIGINT, " + ", ".join(f"{v}::DOUBLE" for v in p) + ")" for i, p in enumerate(params)
    )
    return _sql_log(name) + f""", params(param_id, g, c, e, u) AS (VALUES {values}),
    corr AS (SELECT src, dst, cnt,
        CAST(format('{{:.2f}}', cnt / sum(cnt) OVER (PARTITION BY src)) AS DOUBLE) AS corr FROM dfg),
    sigs AS (SELECT activity, freq, CAST(format('{{:.2f}}', freq / max(freq) OVER ()) AS DOUBLE) AS sig
        FROM stats),
    pairs AS (SELECT x.activity AS src, y.activity AS dst, x.sig AS src_sig, f.cnt,
        coalesce(f.corr, 0.0::DOUBLE) AS corr, coalesce(r.corr, 0.0::DOUBLE) AS rev
        FROM sigs x JOIN sigs y ON x.activity <> y.activity
        LEFT JOIN corr f ON f.src = x.activity AND f.dst = y.activity
        LEFT JOIN corr r ON r.src = y.activity AND r.dst = x.activity),
    nodes AS (SELECT param_id, activity, any_value(freq) AS freq, any_value(sig) AS sig,
        any_value(g) AS g, bool_and(coalesce(corr < c AND rev < c AND sig < g, true)) AS removed
        FROM params CROSS JOIN sigs LEFT JOIN pairs ON src = activity GROUP BY param_id, activity),
    live AS (SELECT param_id, activity, freq, sig, g FROM nodes WHERE NOT removed),
    util AS (SELECT p.param_id, src, dst, cnt, corr, rev, c, e, u,
        CASE WHEN u = 0 AND e = 0 THEN 0.0::DOUBLE
            ELSE round_even((src_sig * u + (1 - u) * corr) * 100, 0) / 100 END AS util
        FROM params p JOIN pairs ON true
        JOIN live a ON a.param_id = p.param_id AND a.activity = src
        JOIN live b ON b.param_id = p.param_id AND b.activity = dst),
    bounds AS (SELECT l.param_id, l.activity AS dst, coalesce(max(util), 0.0::DOUBLE) AS max_util,
        min(util) FILTER (util <> 0) AS min_util
        FROM live l LEFT JOIN util x ON x.param_id = l.param_id AND x.dst = l.activity
        GROUP BY l.param_id, l.activity),
    scaled AS (SELECT util.*, CASE WHEN util = min_util OR max_util = min_util OR min_util IS NULL THEN 0.0::DOUBLE
        ELSE round_even((util - min_util) / (max_util - min_util) * 100, 0) / 100 END AS raw
        FROM util JOIN bounds USING (param_id, dst)),
    norms AS (SELECT *, CASE WHEN raw >= e AND raw > 0 AND corr > 0 AND NOT (u = 0 AND e = 0)
        THEN raw ELSE 0.0::DOUBLE END AS norm FROM scaled),
    filtered AS (SELECT param_id, src, dst FROM norms WHERE corr > 0 AND norm = 0
        AND param_id IN (SELECT param_id FROM norms WHERE norm > 0)),
    seeds AS (SELECT param_id, activity, row_number() OVER (PARTITION BY param_id ORDER BY activity) AS k
        FROM live WHERE sig < g),
    near AS (SELECT s.param_id, s.k, s.activity,
        coalesce(list(n.dst ORDER BY n.dst) FILTER (n.dst IS NOT NULL), []) AS others
        FROM seeds s LEFT JOIN norms n
            ON n.param_id = s.param_id AND n.src = s.activity AND (n.corr >= n.c OR n.rev >= n.c)
        GROUP BY ALL),
    walk AS (SELECT param_id, 0::BIGINT AS k, []::VARCHAR[] AS claimed, []::VARCHAR[] AS leads FROM params
        UNION ALL
        SELECT w.param_id, n.k, list_concat(w.claimed, f.fresh),
            list_concat(w.leads, list_transform(f.fresh, lambda x: n.activity))
        FROM walk w JOIN near n ON n.param_id = w.param_id AND n.k = w.k + 1,
        LATERAL (SELECT CASE WHEN list_contains(w.claimed, n.activity) THEN []::VARCHAR[]
            ELSE list_prepend(n.activity, list_filter(n.others, lambda x: NOT list_contains(w.claimed, x)))
            END AS fresh) f),
    owner AS (SELECT param_id, unnest(claimed) AS activity, unnest(leads) AS leader FROM (
        SELECT DISTINCT ON (param_id) * FROM walk ORDER BY param_id, k DESC)),
    clusters AS (SELECT o.param_id, leader, count(*) AS size,
        CAST(format('{{:.2f}}', sum(round(sig * 100)::BIGINT)::DOUBLE / 100 / count(*)) AS DOUBLE) AS sig,
        row_number() OVER (PARTITION BY o.param_id ORDER BY leader) AS number
        FROM owner o JOIN live USING (param_id, activity) GROUP BY o.param_id, leader),
    link_ends AS (SELECT n.param_id, n.src AS a, n.dst AS b, corr,
        coalesce(x.leader, n.src) AS src, CASE WHEN x.leader IS NULL THEN 'activity' ELSE 'cluster' END AS src_kind,
        coalesce(y.leader, n.dst) AS dst, CASE WHEN y.leader IS NULL THEN 'activity' ELSE 'cluster' END AS dst_kind
        FROM norms n LEFT JOIN owner x ON x.param_id = n.param_id AND x.activity = n.src
        LEFT JOIN owner y ON y.param_id = n.param_id AND y.activity = n.dst
        WHERE corr > 0 AND (x.leader IS NULL OR y.leader IS NULL OR x.leader <> y.leader)),
    edges AS (SELECT param_id, src, src_kind, dst, dst_kind, count(*) AS links,
        CASE WHEN src_kind = 'activity' AND dst_kind = 'activity' THEN any_value(corr)
            ELSE round_even(sum(round(corr * 100)::BIGINT)::DOUBLE / 100 / count(*) * 100, 0) / 100
            END AS value
        FROM link_ends WHERE NOT (src_kind = 'activity' AND dst_kind = 'activity'
            AND (param_id, a, b) IN (SELECT (param_id, src, dst) FROM filtered))
        GROUP BY param_id, src, src_kind, dst, dst_kind),
    graph_nodes AS (SELECT param_id, activity AS node, 'activity' AS node_kind, sig, freq, 1::BIGINT AS size,
        NULL::BIGINT AS number FROM live
        WHERE (param_id, activity) NOT IN (SELECT (param_id, activity) FROM owner)
        UNION ALL SELECT param_id, leader, 'cluster', sig, NULL, size, number FROM clusters)
    """


def _run(spark, sf_dir, name: str, params: list[tuple]) -> tm.FuzzyRun:
    return tm.FuzzyRun(tm.FuzzyBase(_model(spark, sf_dir, name)), [tm.FuzzyParams(*p) for p in params])


for _name in LOGS:
    _query(
        f"outgoing_{_name}",
        lambda s, d, n=_name: tm.outgoing(_model(s, d, n)),
        _sql_log(_name) + "SELECT src, sum(cnt)::BIGINT AS total FROM dfg GROUP BY src",
    )
    _query(
        f"correlation_{_name}",
        lambda s, d, n=_name: tm.correlation(_model(s, d, n)),
        _sql_log(_name) + """SELECT src, dst, cnt,
            CAST(format('{:.2f}', cnt / sum(cnt) OVER (PARTITION BY src)) AS DOUBLE) AS corr FROM dfg""",
    )
    _query(
        f"significance_{_name}",
        lambda s, d, n=_name: tm.significance(_model(s, d, n)),
        _sql_log(_name) + """SELECT activity, freq,
            CAST(format('{:.2f}', freq / max(freq) OVER ()) AS DOUBLE) AS sig FROM stats""",
    )

_FUZZY = {
    # what of a run: the Spark table, the same in SQL
    "significance_of_links": (
        lambda r: r.base.links.select("src", "dst", "corr", "src_sig"),
        "SELECT src, dst, corr, src_sig FROM pairs WHERE cnt IS NOT NULL",
    ),
    "removed_nodes": (lambda r: r.removed, "SELECT param_id, activity FROM nodes WHERE removed"),
    "surviving_nodes": (
        lambda r: r.live, "SELECT param_id, activity, freq, sig FROM live",
    ),
    "surviving_links": (
        lambda r: r.links.select("param_id", "src", "dst", "cnt", "corr"),
        "SELECT param_id, src, dst, cnt, corr FROM norms WHERE cnt IS NOT NULL",
    ),
    "utility": (
        lambda r: r.utility.select("param_id", "src", "dst", "util"),
        "SELECT param_id, src, dst, util FROM util WHERE cnt IS NOT NULL",
    ),
    "utility_bounds": (
        lambda r: r.utility_bounds, "SELECT param_id, dst, max_util, min_util FROM bounds",
    ),
    "normalised_utility": (
        lambda r: r.normalised,
        "SELECT param_id, src, dst, util, norm FROM norms WHERE cnt IS NOT NULL",
    ),
    "filtered_edges": (lambda r: r.filtered, "SELECT param_id, src, dst FROM filtered"),
    "seeds": (lambda r: r.seeds, "SELECT param_id, activity FROM seeds"),
    "cluster_members": (lambda r: r.clusters, "SELECT param_id, activity, leader FROM owner"),
    "cluster_names": (
        lambda r: r.cluster_names,
        """SELECT param_id, leader, activity,
            row_number() OVER (PARTITION BY param_id, leader ORDER BY activity) AS position FROM owner""",
    ),
    "cluster_nodes": (
        lambda r: r.cluster_nodes, "SELECT param_id, leader, number, size, sig FROM clusters",
    ),
    "node_significance": (
        lambda r: r.node_significance,
        """SELECT n.param_id, n.activity, removed,
            CASE WHEN NOT removed THEN coalesce(k.sig, n.sig) END AS sig
            FROM nodes n LEFT JOIN owner o ON o.param_id = n.param_id AND o.activity = n.activity
            LEFT JOIN clusters k ON k.param_id = n.param_id AND k.leader = o.leader""",
    ),
    "plain_nodes": (
        lambda r: r.plain_nodes.select("param_id", "activity", "freq", "sig"),
        "SELECT param_id, node AS activity, freq, sig FROM graph_nodes WHERE node_kind = 'activity'",
    ),
}
for _a in ("activity", "cluster"):
    for _b in ("activity", "cluster"):
        _FUZZY[f"edges_{_a}_to_{_b}"] = (
            lambda r, a=_a, b=_b: r.edges.where((F.col("src_kind") == a) & (F.col("dst_kind") == b)),
            f"SELECT * FROM edges WHERE src_kind = '{_a}' AND dst_kind = '{_b}'",
        )
for _what, (_pick, _sql) in _FUZZY.items():
    _query(
        f"fuzzy_{_what}",
        lambda s, d, p=_pick: p(_run(s, d, "banded", [MAIN])),
        _sql_fuzzy("banded", [MAIN]) + _sql,
    )
for _what in ("removed_nodes", "utility_bounds", "filtered_edges", "cluster_members", "cluster_nodes"):
    _query(
        f"fuzzy_sweep_{_what}",
        lambda s, d, p=_FUZZY[_what][0]: p(_run(s, d, "banded", GRID)),
        _sql_fuzzy("banded", GRID) + _FUZZY[_what][1],
    )
_query(
    "fuzzy_sweep_edges",
    lambda s, d: _run(s, d, "banded", GRID).graph(sizes=False).edges,
    _sql_fuzzy("banded", GRID) + "SELECT * FROM edges",
)
# Neighbouring settings, most of which have the outcome of another one.
NEIGHBOURS = [(0.5, c / 100, 0.4, 0.5) for c in range(31)] + [(0.5, 0.1, e / 10, 0.5) for e in range(11)]
for _what in ("normalised_utility", "cluster_members"):
    _query(
        f"fuzzy_sweep_neighbours_{_what}",
        lambda s, d, p=_FUZZY[_what][0]: p(_run(s, d, "conversations", NEIGHBOURS)),
        _sql_fuzzy("conversations", NEIGHBOURS) + _FUZZY[_what][1],
    )
    _query(
        f"fuzzy_sweep_neighbours_{_what}_banded",
        lambda s, d, p=_FUZZY[_what][0]: p(_run(s, d, "banded", NEIGHBOURS)),
        _sql_fuzzy("banded", NEIGHBOURS) + _FUZZY[_what][1],
    )

for _name, _p in (("banded", MAIN), ("banded", GRID[0]), ("conversations", (0.5, 0.2, 0.1, 0.5)), ("lineitem", (0.5, 0.3, 0.2, 0.3))):
    _tag = f"{_name}_" + "_".join(str(v).replace(".", "") for v in _p)
    _query(
        f"fuzzy_graph_edges_{_tag}",
        lambda s, d, n=_name, p=_p: tm.fuzzy_graph(_model(s, d, n), *p, sizes=False).edges,
        _sql_fuzzy(_name, [_p]) + "SELECT * EXCLUDE (param_id) FROM edges",
    )
    _query(
        f"fuzzy_graph_nodes_{_tag}",
        lambda s, d, n=_name, p=_p: tm.fuzzy_graph(_model(s, d, n), *p, sizes=False).nodes,
        _sql_fuzzy(_name, [_p]) + "SELECT * EXCLUDE (param_id) FROM graph_nodes",
    )


def _chained_orders(spark, sf_dir):
    """Clusters of orders, each linked to the next one but where a customer number breaks the chain."""
    label = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", label.alias("activity"))
    orders = ranked(orders, ["o_orderkey"], "place")
    before = orders.select((F.col("place") + 1).alias("place"), F.col("activity").alias("a"))
    linked = orders.where("o_custkey % 251 <> 0").join(before, "place")
    seeds = orders.select(F.lit(0).alias("param_id"), "activity")
    links = linked.select(F.lit(0).alias("param_id"), "a", F.col("activity").alias("b"))
    return clusters(seeds, links).select("activity", "leader")


_query(
    "clusters_chained_orders",
    _chained_orders,
    """WITH ranked AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS activity, o_orderkey AS k,
            lag(lpad(o_orderkey::VARCHAR, 12, '0')) OVER (ORDER BY o_orderkey) AS before, o_custkey % 251 = 0 AS cut FROM orders),
        runs AS (SELECT *, sum(cut::INT) OVER (ORDER BY k) AS run FROM ranked),
        placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) AS place FROM runs)
    SELECT activity, CASE WHEN place % 2 = 1 THEN activity ELSE before END AS leader FROM placed""",
)
_query(
    "fuzzy_graph_sized_nodes_banded",
    lambda s, d: tm.fuzzy_graph(_model(s, d, "banded"), *MAIN).nodes,
    _sql_fuzzy("banded", [MAIN]) + _sql_bands("freqs", "SELECT freq AS v, 1 AS w FROM stats")
    + """SELECT g.* EXCLUDE (param_id),
        CASE node_kind WHEN 'cluster' THEN 1.5::DOUBLE ELSE band / 2 + 1.5::DOUBLE END AS width,
        CASE node_kind WHEN 'cluster' THEN 1.0::DOUBLE ELSE (band / 2 + 1.5::DOUBLE) / 3 END AS height
        FROM graph_nodes g LEFT JOIN freqs ON node_kind = 'activity' AND v = freq""",
)
_query(
    "fuzzy_graph_sized_nodes_words",
    lambda s, d: tm.fuzzy_graph(_model(s, d, "words"), 0.05, 0.3, 0.2, 0.5).nodes,
)
_query(
    "fuzzy_graph_edges_words",
    lambda s, d: tm.fuzzy_graph(_model(s, d, "words"), 0.05, 0.3, 0.2, 0.5, sizes=False).edges,
)
_FEW = (0.5, 0.2, 0.1, 0.5)
_SQL_FUZZY_DOT = _sql_bands("freqs", "SELECT freq AS v, 1 AS w FROM stats") + r"""
        , widths AS (SELECT activity, band / 2 + 1.5::DOUBLE AS width FROM stats JOIN freqs ON v = freq),
        ids AS (SELECT *, '"' || CASE node_kind WHEN 'cluster' THEN 'cluster:' ELSE '' END || node || '"' AS id
            FROM graph_nodes LEFT JOIN widths ON node_kind = 'activity' AND activity = node),
        arrows AS (SELECT *, '"' || CASE src_kind WHEN 'cluster' THEN 'cluster:' ELSE '' END || src || '" -> "'
            || CASE dst_kind WHEN 'cluster' THEN 'cluster:' ELSE '' END || dst || '"' AS id FROM edges)
        SELECT 0 AS section, '' AS key, 'digraph {' AS line UNION ALL SELECT 9, '', '}'
        UNION ALL SELECT 1, id, chr(9) || id || ' [label=' || CASE node_kind WHEN 'activity'
            THEN '<' || node || '<br/><font color="red">' || sig || '</font>> width="' || width || '" height="' || width / 3
                || '" shape="box" style="filled" fillcolor="#FDFFF5"]'
            ELSE '"Cluster ' || number || '\n' || size || ' Elements\n~' || sig
                || '" width="1.5" height="1.0" shape="octagon" style="filled" fillcolor="#6495ED"]' END FROM ids
        UNION ALL SELECT 2, id, chr(9) || id || ' [label="' || value || '" penwidth="0.1"'
            || CASE WHEN src_kind = 'cluster' OR dst_kind = 'cluster' THEN ' color="red"' ELSE '' END || ']'
            FROM arrows"""
_query(
    "fuzzy_dot_conversations",
    lambda s, d: tm.fuzzy_dot(tm.fuzzy_graph(_model(s, d, "conversations"), *_FEW)),
    _sql_fuzzy("conversations", [_FEW]) + _SQL_FUZZY_DOT,
)
_query(
    "fuzzy_dot_banded",
    lambda s, d: tm.fuzzy_dot(tm.fuzzy_graph(_model(s, d, "banded"), *MAIN)),
    _sql_fuzzy("banded", [MAIN]) + _SQL_FUZZY_DOT,
)


# -- bands, graph checks, rounding ---------------------------------------------------

_query(
    "frequency_bands_words",
    lambda s, d: tm.frequency_bands(tm.activity_frequency(_log(s, d, "words")), "freq"),
    _sql_log("words") + _sql_bands("freqs", "SELECT freq AS v, 1 AS w FROM stats")
    + "SELECT activity, freq, band FROM stats JOIN freqs ON v = freq",
)
_query(
    "frequency_bands_of_totals",
    lambda s, d: tm.frequency_bands(
        _table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"
    ),
    "WITH orders_ AS (SELECT o_orderkey, o_totalprice FROM orders)"
    + _sql_bands("prices", "SELECT o_totalprice AS v, 1 AS w FROM orders_")
    + "SELECT o_orderkey, o_totalprice, band FROM orders_ JOIN prices ON v = o_totalprice",
)
# Up to eight distinct values each have a band of their own.
_query(
    "frequency_bands_events",
    lambda s, d: tm.frequency_bands(tm.activity_frequency(_log(s, d, "events")), "freq"),
    _sql_log("events") + """SELECT activity, freq,
        (dense_rank() OVER (ORDER BY freq) - 1)::DOUBLE AS band FROM stats""",
)

for _name, _theta, _freq in (("conversations", 0.5, 1), ("banded", 0.2, 10), ("words", 0.9, 5)):
    _edges = _sql_heuristic_edges(_name, _theta, _freq)
    _degrees = _edges + """, ends_of AS (SELECT src AS node, src_kind AS node_kind, 0 AS i, 1 AS o FROM edges
        UNION ALL SELECT dst, dst_kind, 1, 0 FROM edges UNION ALL SELECT node, node_kind, 0, 0 FROM nodes),
        degrees AS (SELECT node, node_kind, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree
            FROM ends_of GROUP BY ALL)
        """
    _graph = lambda s, d, n=_name, t=_theta, f=_freq: tm.heuristic_graph(_model(s, d, n), t, f, sizes=False)
    _query(f"degrees_{_name}", lambda s, d, g=_graph: tm.degrees(g(s, d)), _degrees + "SELECT * FROM degrees")
    _query(
        f"source_nodes_{_name}",
        lambda s, d, g=_graph: tm.source_nodes(g(s, d)),
        _degrees + "SELECT node, node_kind, out_degree FROM degrees WHERE in_degree = 0",
    )
    _query(
        f"sink_nodes_{_name}",
        lambda s, d, g=_graph: tm.sink_nodes(g(s, d)),
        _degrees + "SELECT node, node_kind, in_degree FROM degrees WHERE out_degree = 0",
    )

    def _from_start(s, d, g=_graph):
        graph = g(s, d)
        return tm.reachable(graph, graph.nodes.where("node_kind = 'start'"))

    _query(
        f"reachable_{_name}",
        _from_start,
        _edges + """, reached AS (SELECT 'start' AS node, 'start' AS node_kind
            UNION SELECT e.dst, e.dst_kind FROM reached r
            JOIN edges e ON e.src = r.node AND e.src_kind = r.node_kind)
            SELECT node, node_kind, (node, node_kind) IN (SELECT (node, node_kind) FROM reached) AS reached
            FROM nodes""",
    )
    _query(
        f"graph_summary_{_name}",
        lambda s, d, g=_graph: tm.summary(g(s, d)),
        _edges + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges",
    )


# One path through all orders, in key order, with forks that lead nowhere.
_FORK = "o_orderkey % 4000 = 0"


def _chain(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    keys = orders.select("o_orderkey").union(
        orders.where(_FORK).selectExpr("-1 - o_orderkey")
    ).distinct()
    ranks = ranked(orders.select("o_orderkey").distinct(), ["o_orderkey"], "rank")
    after = ranks.select((F.col("rank") - 1).alias("rank"), F.col("o_orderkey").alias("b"))
    steps = ranks.join(after, "rank").select(F.col("o_orderkey").alias("a"), "b").union(
        orders.where(_FORK).selectExpr("o_orderkey", "-1 - o_orderkey")
    )
    node = lambda c: F.col(c).cast("string")
    kind = F.lit("activity")
    graph = tm.ProcessGraph(
        keys.select(node("o_orderkey").alias("node"), kind.alias("node_kind")),
        steps.select(node("a").alias("src"), kind.alias("src_kind"), node("b").alias("dst"), kind.alias("dst_kind")),
    )
    middle = orders.agg(F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY o_orderkey) as bigint)").alias("m"))
    return tm.reachable(graph, graph.nodes.join(middle, F.col("node") == F.col("m").cast("string")))


_query(
    "reachable_long_chain_orders",
    _chain,
    """WITH middle AS (SELECT quantile_disc(o_orderkey, 0.5) AS m FROM orders)
        SELECT o_orderkey::VARCHAR AS node, 'activity' AS node_kind, o_orderkey >= m AS reached FROM orders, middle
        UNION ALL SELECT (-1 - o_orderkey)::VARCHAR, 'activity', o_orderkey >= m FROM orders, middle
        WHERE """ + _FORK,
)


# Two sides of a ladder whose rungs are all orders, in key order: every step forks.
def _ladder(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    ranks = written(ranked(orders, ["o_orderkey"], "rank"), "ranks")
    orders = ranks.select("o_orderkey")
    after = ranks.select((F.col("rank") - 1).alias("rank"), F.col("o_orderkey").alias("b"))
    up = ranks.join(after, "rank").select(F.col("o_orderkey").alias("a"), "b")
    ends = up.selectExpr("inline(array(struct(a as x, b as y), struct(-a as x, -b as y)))")
    across = orders.selectExpr("inline(array(struct(o_orderkey as x, -o_orderkey as y), struct(-o_orderkey as x, o_orderkey as y)))")
    node = lambda c: F.col(c).cast("string")
    kind = F.lit("activity")
    graph = tm.ProcessGraph(
        orders.selectExpr("explode(array(o_orderkey, -o_orderkey)) as node").select(node("node").alias("node"), kind.alias("node_kind")),
        ends.union(across).select(
            node("x").alias("src"), kind.alias("src_kind"), node("y").alias("dst"), kind.alias("dst_kind")
        ),
    )
    # The median by its rank: an aggregate would hold all keys in one task. A key that is null comes first and does not count.
    last, n = ranks.agg(F.max("rank"), F.count("o_orderkey")).first()
    middle = ranks.where(F.col("rank") == (last or 0) - n + (n + 1) // 2).select(F.col("o_orderkey").alias("m"))
    return tm.reachable(graph, graph.nodes.join(middle, F.col("node") == F.col("m").cast("string")))


_query(
    "reachable_ladder_orders",
    _ladder,
    """WITH middle AS (SELECT quantile_disc(o_orderkey, 0.5) AS m FROM orders),
        sides AS (SELECT o_orderkey, unnest([o_orderkey, -o_orderkey]) AS node FROM orders)
        SELECT node::VARCHAR AS node, 'activity' AS node_kind, o_orderkey >= m AS reached FROM sides, middle""",
)


def _rounding(spark, sf_dir):
    x = (F.col("l_quantity") / 200).alias("x")
    shares = _table(spark, sf_dir, "lineitem").select(x).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return shares.select("x", "n", fmt2(F.col("x")).alias("as_text"), np2(F.col("x")).alias("scaled"))


_query(
    "two_decimals_lineitem",
    _rounding,
    """SELECT x, n, CAST(format('{:.2f}', x) AS DOUBLE) AS as_text, round_even(x * 100, 0) / 100 AS scaled
        FROM (SELECT l_quantity / 200 AS x, count(*) AS n FROM lineitem GROUP BY 1)""",
)
_query(
    "ranked_orders",
    lambda s, d: ranked(
        _table(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], "rank",
        keys=["o_custkey"], one_task_rows=0,
    ),
    """SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders""",
)


# -- text operators and the pipeline on them -------------------------------------------

# Its own absence, and that of a library it needs, leaves the text part out.
_TEXT_PART = ("corpus_pipeline", "tracemill.llm")
_TEXT_LIBRARIES = ("numpy", "pandas", "public_tokenizers", "pyarrow", "regex", "tokenizers", "xxhash", "zstandard")

try:
    import corpus_pipeline
    from tracemill.llm import queries as text_queries
except ModuleNotFoundError as missing:
    if missing.name in _TEXT_LIBRARIES:
        warnings.warn(f"no text operators: {missing.name} is not installed", stacklevel=2)
    elif missing.name not in _TEXT_PART:
        raise
else:
    _QUERIES.update(text_queries.QUERIES)
    _ORACLE.update(text_queries.ORACLE)
    _query("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)


# -- driver contract -----------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """The dependency graph of the conversations at the smallest scale."""
    model = _model(spark, "/root/testdata/sf0.001", "conversations")
    return tm.heuristic_graph(model, 0.1, 1).edges


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
