from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtures import LOGS, log_of, model_of, rows, steps_of
from tracemill import (
    HeuristicParams,
    dependencies,
    dependency_cells,
    dependency_edges,
    directly_follows,
    end_activities,
    fuzzy_graph,
    heuristic_graph,
    heuristic_sweep,
    max_frequency,
    outgoing,
    start_activities,
    vocabulary,
    zero_cells,
)
from tracemill.operators import follows
from tracemill.operators.bands import band_cuts
from tracemill.operators.blocks import block_ways
from tracemill.operators.follows import both_ways
from tracemill.operators.ordering import steps
from tracemill.plans.heuristic import dependency_bands


@pytest.fixture(scope="module")
def models(spark):
    return {name: model_of(spark, traces) for name, traces in LOGS.items()}


def dense(traces):
    """Dependency of every pair, from the definition."""
    names = sorted({a for t in traces for a in t})
    s = {(a, b): 0 for a in names for b in names}
    for t in traces:
        for a, b in zip(t, t[1:]):
            s[a, b] += 1
    return {
        (a, b): n / (n + 1) if a == b else (n - s[b, a]) / (n + s[b, a] + 1)
        for (a, b), n in s.items()
    }


@pytest.mark.parametrize("name", LOGS)
@pytest.mark.parametrize("theta,freq", [(0.5, 1), (0.1, 1), (0.0, 1), (0.9, 1), (0.5, 3), (-1.0, 2)])
def test_edges(models, name, theta, freq):
    matrix, steps = dense(LOGS[name]), steps_of(LOGS[name])
    want = sorted((a, b, n) for (a, b), n in steps.items() if n >= freq and matrix[a, b] >= theta)
    assert rows(dependency_edges(models[name], theta, freq), "src", "dst", "cnt") == want


@pytest.mark.parametrize("name", LOGS)
def test_counts_and_dependencies(models, name):
    traces, matrix = LOGS[name], dense(LOGS[name])
    found = rows(dependencies(models[name]), "src", "dst", "cnt", "dependency")
    assert found == sorted((a, b, n, matrix[a, b]) for (a, b), n in steps_of(traces).items())
    frequency = Counter(a for t in traces for a in t)
    assert dict(rows(models[name].activities, "activity", "freq")) == frequency
    assert dict(rows(models[name].starts, "activity", "cases")) == Counter(t[0] for t in traces)
    assert dict(rows(models[name].ends, "activity", "cases")) == Counter(t[-1] for t in traces)
    assert max_frequency(models[name].activities).first()[0] == max(frequency.values())


def test_known_dependencies(models):
    # worked out by hand: 3 against 0, 4 against 1, a pair with itself, and a tie
    known = {("parcel", "book", "pack"): (4 - 1) / (4 + 1 + 1), ("loops", "q", "q"): 4 / 5,
             ("apart", "m", "n"): (2 - 1) / (2 + 1 + 1), ("shift", "cut", "weld"): (9 - 8) / (9 + 8 + 1)}
    for (name, a, b), want in known.items():
        cells = {(x, y): d for x, y, d in rows(dependency_cells(models[name]), "src", "dst", "dependency")}
        assert cells[a, b] == want


@pytest.mark.parametrize("name", ["parcel", "loops", "apart"])
def test_cells_are_the_whole_matrix(models, name):
    matrix = dense(LOGS[name])
    cells = {(a, b): d for a, b, d in rows(dependency_cells(models[name]), "src", "dst", "dependency")}
    assert {k: v for k, v in matrix.items() if k in cells} == cells
    assert all(v == 0 for k, v in matrix.items() if k not in cells)
    left_out = dict(rows(zero_cells(models[name]), "src", "zero_cells"))
    for a in {a for a, _ in matrix}:
        assert left_out[a] == sum(1 for k in matrix if k[0] == a and k not in cells)


def test_sweep_equals_single_settings(models):
    params = [HeuristicParams(t, f) for t in (0.0, 0.1, 0.5, 0.9) for f in (1, 3)]
    swept = rows(heuristic_sweep(models["parcel"], params), "param_id", "src", "dst", "cnt", "dependency")
    for i, p in enumerate(params):
        single = rows(dependency_edges(models["parcel"], p.dependency, p.min_frequency),
                      "src", "dst", "cnt", "dependency")
        assert [r[1:] for r in swept if r[0] == i] == single


def test_log_operators_agree_with_model(spark, models):
    log = log_of(spark, LOGS["parcel"])
    m = models["parcel"]
    assert rows(directly_follows(log), "src", "dst", "cnt") == rows(m.dfg, "src", "dst", "cnt")
    assert rows(start_activities(log), "activity", "cases") == rows(m.starts, "activity", "cases")
    assert rows(end_activities(log), "activity", "cases") == rows(m.ends, "activity", "cases")
    by_label = [a for _, a in rows(vocabulary(log), "position", "activity")]
    assert by_label == ["back", "book", "cancel", "pack", "send", "sign"]
    first_seen = [a for _, a in rows(vocabulary(log, "first_seen"), "position", "activity")]
    assert first_seen == ["book", "pack", "send", "sign", "back", "cancel"]


@pytest.mark.parametrize("name", ["loops", "apart"])
def test_graph(models, name):
    g = heuristic_graph(models[name], 0.5, 1)
    nodes = {r["node"]: r for r in g.nodes.collect()}
    frequency = Counter(a for t in LOGS[name] for a in t)
    ranks = {f: i for i, f in enumerate(sorted(set(frequency.values())))}
    assert set(nodes) == set(frequency) | {"start", "end"}
    for a, f in frequency.items():
        assert nodes[a]["label"] == f"{a}\n{f}" and nodes[a]["width"] == 1.5 + ranks[f] / 2
        assert nodes[a]["height"] == nodes[a]["width"] / 3
    edges = {(r["src"], r["dst"]): r for r in g.edges.collect()}
    matrix = dense(LOGS[name])
    bands = {d: i for i, d in enumerate(sorted({d for d in matrix.values() if d >= 0}))}
    assert len(bands) <= 8  # each has a band of its own
    for (a, b), n in steps_of(LOGS[name]).items():
        assert ((a, b) in edges) == (matrix[a, b] >= 0.5)
        if (a, b) in edges:
            assert edges[a, b]["penwidth"] == 1.0 + bands[matrix[a, b]] and edges[a, b]["label"] == str(n)
    for t in LOGS[name]:
        assert edges["start", t[0]]["penwidth"] == 0.1 and (t[-1], "end") in edges
    assert all(r["penwidth"] == 0.1 for r in heuristic_graph(models[name], 0, 1).edges.collect())


def test_halves_of_a_graph_are_found_apart(spark, models):
    store = spark.sparkContext.statusTracker()

    def jobs(group, build):
        spark.sparkContext.setJobGroup(group, group)
        result = build()
        started = len(store.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return result, started

    graph, started = jobs("heuristic", lambda: heuristic_graph(models["shift"], 0.5, 1))
    assert started == 0
    _, started = jobs("heuristic nodes", lambda: graph.nodes)
    assert "edges" not in graph.__dict__ and started > 0
    graph, started = jobs("fuzzy", lambda: fuzzy_graph(models["shift"], 0.5, 0.3, 0.4, 0.5))
    assert started == 0
    jobs("fuzzy edges", lambda: graph.edges)
    assert "nodes" not in graph.__dict__


def test_unreachable_frequency_is_refused():
    with pytest.raises(ValueError):
        HeuristicParams(0.0, 0)


def test_directions_meet_where_steps_are_counted(models):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    model = models["parcel"]
    for df in (dependencies(model), dependency_cells(model), dependency_edges(model, 0.5, 2), model.starts, model.ends):
        assert "Exchange" not in plan(df)  # pairs and starts are read off the stored counts, not grouped again
    bands = Counter(d for d in dense(LOGS["parcel"]).values() if d >= 0)
    assert dependency_bands(model) == band_cuts(model.dfg.sparkSession.createDataFrame([(d,) for d in bands], "v double"), "v")


@pytest.mark.parametrize("theta,freq", [(0.5, 1), (0.0, 1), (-1.0, 2), (0.5, 3)])
def test_labels_that_sort_either_way(spark, theta, freq):
    traces = [["b", "a", "b", "", "b"], ["", ""], ["é", "z", "é", "Z"], ["b"], [], ["a", "b", "a", "b"]]
    model, matrix, counts = model_of(spark, traces), dense(traces), steps_of(traces)
    edges = rows(dependency_edges(model, theta, freq), "src", "dst", "cnt")
    assert edges == sorted((a, b, n) for (a, b), n in counts.items() if n >= freq and matrix[a, b] >= theta)
    assert dict(rows(model.starts, "activity", "cases")) == Counter(t[0] for t in traces if t)
    assert dict(rows(model.ends, "activity", "cases")) == Counter(t[-1] for t in traces if t)
    assert dict(rows(model.activities, "activity", "freq")) == Counter(a for t in traces for a in t)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_blocks_count_what_their_task_holds_in_parts(spark, block):
    traces = [["b", "a", "b", "", "b"], ["", ""], ["é", "z", "é", "Z"], ["b"], [], ["a", "b", "a", "b"], ["x" * 300, "b"]] * 3
    log = log_of(spark, traces)
    log.rows = log.rows.union(spark.createDataFrame([(99, None)], log.rows.schema)).coalesce(1)  # a text that is null
    found = block_ways(log.rows, block)
    sent = Counter((r["low"], r["high"]) for r in found.collect())
    assert block < 1000 or set(sent.values()) == {1}
    summed = found.groupBy("low", "high").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    want = both_ways(steps(log)).where("high is not null")
    order = ["low", "high", "up", "down"]
    assert summed.where("high is not null").exceptAll(want).isEmpty() and want.exceptAll(summed).isEmpty()
    ends, frequency = Counter(t[-1] for t in traces if t), Counter(a for t in traces for a in t)
    each = rows(summed.where("high is null"), *order)
    assert each == sorted((a, None, ends[a], n) for a, n in frequency.items())


def test_steps_of_traces_move_without_a_table_of_their_pairs(spark, models):
    log = log_of(spark, LOGS["parcel"])
    plan = plan_of(follows._counted(log))
    before_shuffle = plan[plan.index("Exchange"):]
    assert "MapInArrow" in before_shuffle and "Aggregate" not in before_shuffle
    for df in (models["parcel"].activities, outgoing(models["parcel"])):
        assert "Exchange" not in plan_of(df)  # read off, where all pairs were grouped
