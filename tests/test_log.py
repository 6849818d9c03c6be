import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fixtures import LOGS, log_of, model_of, rows
from tracemill import (
    DelimiterError,
    EventLog,
    MissingColumnError,
    base_model,
    detect_delimiter,
    directly_follows,
    end_activities,
    ordered_events,
    read_csv,
    read_traces,
    start_activities,
    trace_lines,
    traces,
    vocabulary,
    write_traces,
)
from tracemill.operators.ordering import hot_cases, split_hot_cases
from tracemill.operators.ranking import ranked


def brute(events):
    """Counts of (case, ts, tie, activity) rows, from the definition."""
    last = float("inf")
    cases = {}
    for case, ts, tie, act in events:
        if case is not None and act is not None:
            cases.setdefault(case, []).append((last if ts is None else ts, tie, act))
    ordered = {c: [a for _, _, a in sorted(v)] for c, v in cases.items()}
    steps = Counter(p for t in ordered.values() for p in zip(t, t[1:]))
    return ordered, steps


def random_events(seed, copies=False):
    r = random.Random(seed)
    events = []
    for i in range(400):
        case = None if r.random() < 0.02 else (0 if r.random() < 0.4 else r.randint(1, 30))
        ts = None if r.random() < 0.05 else r.randint(0, 60)
        act = None if r.random() < 0.02 else r.choice("abcde")
        events.append((case, ts, r.randint(0, 2), act))
    if copies:
        events += [(0, 30, 1, "b")] * 150 + [(99, 1, 1, "c")] * 120
    return events


@pytest.mark.parametrize("limit", [10, 40, 5_000_000])
def test_long_cases_give_the_same_counts(spark, limit):
    events = random_events(limit, copies=True)
    df = spark.createDataFrame(events, "case long, timestamp long, t long, event string")
    log = EventLog(df.repartition(5), tie=["t"], hot_case_rows=limit)
    segments = split_hot_cases(log).segments
    assert (segments is None) == (limit == 5_000_000)
    if segments is not None:
        assert segments.select("seg").distinct().count() > 3
    ordered, steps = brute(events)
    assert {(a, b): n for a, b, n in rows(directly_follows(log), "src", "dst", "cnt")} == steps
    model = base_model(log)
    for found in (model.starts, start_activities(log)):
        assert dict(rows(found, "activity", "cases")) == Counter(t[0] for t in ordered.values())
    for found in (model.ends, end_activities(log)):
        assert dict(rows(found, "activity", "cases")) == Counter(t[-1] for t in ordered.values())
    assert dict(rows(model.activities, "activity", "freq")) == Counter(
        a for t in ordered.values() for a in t)
    positions = rows(ordered_events(log), "case_id", "pos", "activity")
    assert positions == sorted((c, i, a) for c, t in ordered.items() for i, a in enumerate(t, 1))
    parts = rows(traces(log, part_rows=7), "case_id", "part", "trace")
    assert all(len(t) <= 7 for _, _, t in parts)
    joined = {}
    for c, _, t in parts:
        joined.setdefault(c, []).extend(t)
    assert joined == ordered
    assert {c: t for c, t in rows(traces(log), "case_id", "trace")} == ordered


def test_short_segments_need_no_ranges_of_their_own(spark):
    """Segments are cut by the tasks, so that their number costs neither tasks nor a sample on the driver."""
    df = spark.range(4000).selectExpr("id % 2 as case", "id as timestamp", "concat('a', id % 7) as event")
    log = EventLog(df, hot_case_rows=10)
    segments = split_hot_cases(log).segments
    assert len(segments.inputFiles()) <= 2
    sizes = [r["count"] for r in segments.groupBy("seg").count().collect()]
    assert max(sizes) <= 5 and len(sizes) >= 800
    want = Counter((f"a{i % 7}", f"a{(i + 2) % 7}") for i in range(3998))
    assert {(a, b): n for a, b, n in rows(directly_follows(log), "src", "dst", "cnt")} == want


def test_copies_beyond_one_row_are_split(spark, monkeypatch):
    monkeypatch.setattr("tracemill.operators.ordering.COPIES_PER_ROW", 4)
    events = [(1, 1, 1, "a")] * 13 + [(1, 2, 1, "b")] * 3 + [(2, 1, 1, "a")]
    df = spark.createDataFrame(events, "case long, timestamp long, t long, event string")
    log = EventLog(df, tie=["t"], hot_case_rows=2)
    assert rows(directly_follows(log), "src", "dst", "cnt") == [("a", "a", 12), ("a", "b", 1), ("b", "b", 2)]
    ordered, _ = brute(events)
    assert rows(ordered_events(log), "case_id", "pos", "activity") == sorted(
        (c, i, a) for c, t in ordered.items() for i, a in enumerate(t, 1))


def test_trace_logs_are_counted_row_by_row(spark):
    r = random.Random(5)
    long_one = [r.choice("abc") for _ in range(300)]
    log = log_of(spark, [long_one, ["a", None, "b"], ["c"], [None], [], None], hot_case_rows=20)
    want = Counter(zip(long_one, long_one[1:])) + Counter([("a", "b")])
    steps = directly_follows(log)
    assert {(a, b): n for a, b, n in rows(steps, "src", "dst", "cnt")} == want
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "case_id" not in plan
    model = base_model(log)
    assert dict(rows(model.starts, "activity", "cases")) == Counter([long_one[0], "a", "c"])
    assert dict(rows(end_activities(log), "activity", "cases")) == Counter([long_one[-1], "b", "c"])
    assert rows(ordered_events(log).where("case_id = 1"), "pos", "activity") == [(1, "a"), (2, "b")]
    assert rows(traces(log, 200).where("case_id = 0"), "part", "trace") == [(0, long_one[:200]), (1, long_one[200:])]


def test_split_texts_are_taken_apart_once_for_their_steps(spark):
    """No filter for nulls that cannot be there, and none for empty traces that splits every text a second time."""
    texts = spark.createDataFrame([(1, "a b a b"), (2, ""), (3, None), (4, "c")], "id long, text string")
    log = EventLog.from_traces(texts.select("id", F.split("text", " ").alias("trace")), case="id")
    steps = directly_follows(log)
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "lambda" not in plan
    assert rows(steps, "src", "dst", "cnt") == [("a", "b", 2), ("b", "a", 1)]
    model = base_model(log)
    assert rows(model.starts, "activity", "cases") == [("", 1), ("a", 1), ("c", 1)]
    assert rows(model.ends, "activity", "cases") == [("", 1), ("b", 1), ("c", 1)]
    none = EventLog.from_traces(spark.createDataFrame([(1, []), (2, [None])], "id long, trace array<string>"), case="id")
    assert base_model(none).activities.isEmpty()


def test_text_is_taken_apart_twice_at_most(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("\n".join(csv_lines()) + "\n")
    log = read_csv(spark, str(path), sep=",")
    steps = directly_follows(log)
    assert str(path) not in steps._jdf.queryExecution().optimizedPlan().toString()
    assert set(log.events.inputFiles()) == set(directly_follows(log).inputFiles())
    assert not any("log.csv" in f for f in log.events.inputFiles())


def test_dropped_rows_are_counted(spark):
    df = spark.createDataFrame(
        [(None, 1, "a"), (1, 1, None), (None, 1, None), (1, 2, "b")],
        "case long, timestamp long, event string")
    assert tuple(EventLog(df).dropped_rows().first()) == (2, 1)


def test_roles(spark):
    df = spark.createDataFrame([(2, "a", 7), (1, "b", 7)], "when long, what string, who long")
    with pytest.raises(MissingColumnError):
        EventLog(df)
    log = EventLog.from_positions(df)
    assert rows(directly_follows(log), "src", "dst", "cnt") == [("b", "a", 1)]
    with pytest.raises(MissingColumnError):
        EventLog.from_positions(df, case=3)
    swapped = EventLog.from_positions(df, ts=2, case=0)
    assert rows(start_activities(swapped), "activity", "cases") == [("a", 1), ("b", 1)]


def test_text_times_sort_as_text_unless_parsed(spark):
    df = spark.createDataFrame(
        [(1, "02.01.2020", "late"), (1, "10.12.2019", "early")],
        "case long, timestamp string, event string")
    assert rows(directly_follows(EventLog(df)), "src", "dst") == [("late", "early")]
    parsed = EventLog(df, ts_format="dd.MM.yyyy")
    assert rows(directly_follows(parsed), "src", "dst") == [("early", "late")]


def csv_lines(sep=","):
    lines = [sep.join(("timestamp", "event", "case", "temperature"))]
    case = 0
    for t in LOGS["shift"]:
        case += 1
        for day, a in enumerate(t, 1):
            lines.append(sep.join((f"2017-01-{day:02d} 00:00:00", a, str(case), "18")))
    return lines


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_csv(spark, tmp_path, sep):
    path = tmp_path / "log.csv"
    path.write_text("\n".join(csv_lines(sep)) + "\n")
    assert detect_delimiter(spark, str(path)) == sep
    found = base_model(read_csv(spark, str(path)))
    assert rows(found.dfg, "src", "dst", "cnt") == rows(model_of(spark, LOGS["shift"]).dfg, "src", "dst", "cnt")


def test_csv_keeps_file_order_of_ties_and_sorts_numbers_as_numbers(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("time,event,case\n10,z,1\n9,y,1\n9,b,1\n9,x,1\n")
    log = read_csv(spark, str(path), ts="time")
    assert [a for _, a in rows(ordered_events(log), "pos", "activity")] == ["y", "b", "x", "z"]
    assert dict(log.events.dtypes)["ts"] == "bigint"
    with pytest.raises(MissingColumnError):
        read_csv(spark, str(path))


@pytest.mark.parametrize("store", [True, False])
def test_csv_files_follow_their_names_not_their_sizes(spark, tmp_path, store):
    """Equal times in files of uneven size, one of them cut into several splits, one with a header only."""
    folder = tmp_path / "logs"
    folder.mkdir()
    sizes = {"a.csv": 3, "b.csv": 400, "c d.csv": 0, "e.csv": 40}
    want = []
    for name, n in sizes.items():
        labels = [f"{name[0]}{i}" for i in range(n)]
        (folder / name).write_text("\n".join(["timestamp,event,case", *(f"7,{label},1" for label in labels)]) + "\n")
        want += labels
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        log = read_csv(spark, str(folder), sep=",", store=store)
        assert [a for _, a in sorted(tuple(r) for r in ordered_events(log).select("pos", "activity").collect())] == want
        if store:
            assert dict(log.events.dtypes)["tie_0"] == "bigint"  # numbers are shuffled, not paths
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_number_columns(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('timestamp,event,case\n1.5,"b, then ""c""",1\n1.25,a,1\n10,z,1\n')
    log = read_csv(spark, str(path))
    assert dict(log.events.dtypes)["ts"] == "double" and dict(log.events.dtypes)["case_id"] == "bigint"
    assert [a for _, a in rows(ordered_events(log), "pos", "activity")] == ["a", 'b, then "c"', "z"]
    path.write_text('timestamp,event,case\n1,"two\nlines",1\n2,a,1\n')
    log = read_csv(spark, str(path), multi_line=True)
    assert rows(directly_follows(log), "src", "dst") == [("two\nlines", "a")]


def test_csv_ids_stay_apart(spark, tmp_path):
    path = tmp_path / "log.csv"
    for ids in (["123456789012345678901", "123456789012345678902"], ["1d", "1f"], ["1", "01"], ["1.0", "1.00"]):
        one, two = ids
        path.write_text(f"timestamp,event,case\n1,a,{one}\n2,b,{two}\n3,c,{one}\n4,d,{two}\n")
        assert rows(directly_follows(read_csv(spark, str(path))), "src", "dst") == [("a", "c"), ("b", "d")]


def test_csv_numbers_that_only_look_like_it(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("timestamp,event,case\n10d,a,1\n9f,b,1\n")
    assert dict(read_csv(spark, str(path)).events.dtypes)["ts"] == "string"
    long_times = ["99999999999999999999", "100000000000000000000", "99999999999999999998"]
    path.write_text("timestamp,event,case\n" + "".join(f"{t},e{i},1\n" for i, t in enumerate(long_times)))
    log = read_csv(spark, str(path))
    assert dict(log.events.dtypes)["ts"] == "decimal(38,0)"
    assert [a for _, a in rows(ordered_events(log), "pos", "activity")] == ["e2", "e0", "e1"]


def test_csv_ties_sort_as_numbers(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("timestamp,event,case,seq\n" + "".join(f"1,e{i},1,{i}\n" for i in range(1, 12)))
    log = read_csv(spark, str(path), tie=("seq",))
    assert [a for _, a in rows(ordered_events(log), "pos", "activity")] == [f"e{i}" for i in range(1, 12)]


def test_csv_without_delimiter(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("")
    with pytest.raises(DelimiterError):
        detect_delimiter(spark, str(path))


def test_trace_files(spark, tmp_path):
    blank = tmp_path / "t.txt"
    blank.write_text("\n".join(" ".join(t) for t in LOGS["parcel"]) + "\n")
    comma = tmp_path / "c.txt"
    comma.write_text("\n".join(",".join(t) for t in LOGS["parcel"]))
    want = rows(model_of(spark, LOGS["parcel"]).dfg, "src", "dst", "cnt")
    assert rows(directly_follows(read_traces(spark, str(blank), sep=None)), "src", "dst", "cnt") == want
    assert rows(directly_follows(read_traces(spark, str(comma))), "src", "dst", "cnt") == want


def test_write_traces_round_trip(spark, tmp_path):
    log = log_of(spark, LOGS["loops"])
    write_traces(log, str(tmp_path / "out"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == sorted(",".join(t) for t in LOGS["loops"])
    back = read_traces(spark, str(tmp_path / "out"))
    assert rows(directly_follows(back), "src", "dst", "cnt") == rows(directly_follows(log), "src", "dst", "cnt")


@pytest.mark.parametrize("part_rows", [1, 2, 4, 1000])
def test_write_traces_in_parts_round_trip(spark, tmp_path, part_rows):
    log = log_of(spark, LOGS["loops"])
    write_traces(log, str(tmp_path / "cut"), part_rows=part_rows)
    assert [p.name for p in tmp_path.iterdir()] == ["cut"]
    lines = [r[0].split("\t") for r in spark.read.text(str(tmp_path / "cut")).collect()]
    assert all(len(x.split(",")) <= part_rows for _, _, x in lines)
    back = read_traces(spark, str(tmp_path / "cut"), parts=True)
    assert rows(ordered_events(back), "pos", "activity") == rows(ordered_events(log), "pos", "activity")
    assert rows(directly_follows(back), "src", "dst", "cnt") == rows(directly_follows(log), "src", "dst", "cnt")
    assert trace_lines(log, part_rows).count() == sum(-(-len(t) // part_rows) for t in LOGS["loops"])


def test_traces_of_empty_arrays_are_ignored(spark):
    log = log_of(spark, [[], ["a"], []])
    assert rows(start_activities(log), "activity", "cases") == [("a", 1)]
    assert base_model(log_of(spark, [[]])).dfg.count() == 0


@pytest.mark.parametrize("one_task_rows", [0, 1000])
def test_ranked(spark, one_task_rows):
    df = spark.createDataFrame([(k % 3, f"v{k:03d}") for k in range(200)], "k long, v string")
    found = rows(ranked(df, ["v"], "n", one_task_rows=one_task_rows), "n", "v")
    assert found == [(i, f"v{i - 1:03d}") for i in range(1, 201)]
    found = rows(ranked(df, ["v"], "n", ["k"], one_task_rows), "k", "v", "n")
    for k in range(3):
        assert [n for key, _, n in found if key == k] == list(range(1, len([f for f in found if f[0] == k]) + 1))


def test_vocabulary_of_sample(spark):
    log = log_of(spark, LOGS["apart"])
    assert [a for _, a in rows(vocabulary(log, "first_seen"), "position", "activity")] == list("uvxwmn")


def test_timestamps_keep_their_type(spark):
    df = spark.createDataFrame(
        [(1, datetime(2020, 1, 2), "b"), (1, datetime(2020, 1, 1), "a")],
        "case long, timestamp timestamp_ntz, event string")
    assert dict(EventLog(df).events.dtypes)["ts"] == "timestamp_ntz"
    assert rows(directly_follows(EventLog(df)), "src", "dst") == [("a", "b")]


@pytest.mark.parametrize(("limit", "buckets"), [(30, 4096), (30, 3), (1, 4096), (10**6, 4096), (99, 1)])
def test_hot_cases_are_those_of_an_exact_count(spark, limit, buckets):
    events = spark.range(3000).selectExpr("CAST(IF(id % 3 = 0, 7, id % 211) AS STRING) AS case_id", "id")
    found = hot_cases(events, limit, buckets)
    counts = Counter(r.case_id for r in events.collect())
    want = {(c, n) for c, n in counts.items() if n > limit}
    assert (set() if found is None else {tuple(r) for r in found.collect()}) == want
    assert hot_cases(events.where("id < 0"), limit, buckets) is None


def test_cases_are_not_counted_one_by_one(spark):
    """A log without a bucket over the limit has one exchange by case: the one that orders it."""
    log = EventLog(spark.range(1000).selectExpr("id % 50 AS c", "id AS t", "'a' AS e"), case="c", ts="t", activity="e")
    directly_follows(log)
    assert split_hot_cases(log).segments is None and split_hot_cases(log).ordinary is log.events
    plan = directly_follows(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(case_id") == 1


ODD_LABELS = ["", " ", ",", "\\", "\\c", "\\\\t", "a,b", "\t", "x\n", "\r\n", ";", "a;", "\\,", ",\\", "plain", "é,\u2028", "c" * 9000 + "," * 9000]


@pytest.mark.parametrize("part_rows", [None, 1, 4])
def test_escaped_traces_round_trip(spark, tmp_path, part_rows):
    """Labels made of separators, escapes, and line ends come back as they were."""
    r = random.Random(6)
    cases = [[label] for label in ODD_LABELS] + [[r.choice(ODD_LABELS) for _ in range(r.randrange(1, 9))] for _ in range(60)]
    rows_in = [(f"{c}\t,\\", i, label) for c, trace in enumerate(cases) for i, label in enumerate(trace)]
    log = EventLog(spark.createDataFrame(rows_in, "c string, t int, e string"), case="c", ts="t", activity="e")
    write_traces(log, str(tmp_path / "out"), part_rows=part_rows, escape=True)
    back = read_traces(spark, str(tmp_path / "out"), parts=part_rows is not None, escaped=True)
    found = [(r.case_id, tuple(r.trace)) for r in traces(back).collect()]
    assert sorted(t for _, t in found) == sorted(map(tuple, cases))
    if part_rows is not None:
        assert dict(found) == {f"{c}\t,\\": tuple(t) for c, t in enumerate(cases)}
