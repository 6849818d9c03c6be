import random

import pytest

from fixtures import LOGS, model_of, rows
from tracemill import (
    HeuristicParams,
    ProcessGraph,
    dependency_edges,
    degrees,
    fuzzy_dot,
    fuzzy_graph,
    heuristic_dot,
    heuristic_graph,
    heuristic_sweep,
    load_model,
    reachable,
    redraw,
    save_model,
    sink_nodes,
    source_nodes,
    summary,
    write_dot,
)


@pytest.mark.parametrize("name", ["parcel", "shift"])
def test_integrity_of_mined_graphs(spark, name):
    g = heuristic_graph(model_of(spark, LOGS[name]), 0.5, 1, sizes=False)
    assert ("start", "start") in rows(source_nodes(g), "node", "node_kind")
    assert ("end", "end") in rows(sink_nodes(g), "node", "node_kind")
    assert all(d >= 1 for d, in rows(source_nodes(g).where("node_kind = 'start'"), "out_degree"))
    reached = dict((n, r) for n, r in rows(reachable(g, source_nodes(g)), "node", "reached"))
    assert all(reached.values())


def graph_of(spark, n, links):
    nodes = spark.createDataFrame([(f"n{i:02d}", "activity") for i in range(n)], "node string, node_kind string")
    edges = spark.createDataFrame(
        [(f"n{a:02d}", "activity", f"n{b:02d}", "activity") for a, b in links],
        "src string, src_kind string, dst string, dst_kind string")
    return ProcessGraph(nodes, edges)


@pytest.mark.parametrize("plain_rounds", [0, 8])
def test_reachable(spark, plain_rounds):
    r = random.Random(plain_rounds)
    n = 14
    shapes = [(5, [(i, i + 1) for i in range(4)]), (3, [])]
    shapes += [(n, [(a, b) for a in range(n) for b in range(n) if r.random() < 1.3 / n])]
    shapes += [(n, [(a + 1, a) for a in range(n - 1)] + [(0, n - 1)])]
    # a closed path, and paths that meet and part
    shapes += [(12, [(0, 1), (1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (5, 6), (6, 7), (8, 5), (9, 10), (10, 9)])]
    shapes += [(10, [(i, (i + 1) % 6) for i in range(6)] + [(7, 8), (8, 9), (9, 7)])]
    for n, links in shapes:
        g = graph_of(spark, n, links)
        root = g.nodes.where("node = 'n00'")
        seen, todo = set(), [0]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += [y for x, y in links if x == a]
        got = rows(reachable(g, root, plain_rounds), "node", "reached")
        assert got == [(f"n{i:02d}", i in seen) for i in range(n)]


@pytest.mark.parametrize("both_ways", [False, True])
def test_a_ladder_takes_few_rounds(spark, monkeypatch, both_ways):
    """Every step forks and joins: no path is plain, and single edges would take a round per rung."""
    from tracemill import storage
    from tracemill.operators import graph as module

    rungs, stored = 1500, []
    monkeypatch.setattr(storage, "new_dir", lambda s, label, f=storage.new_dir: stored.append(label) or f(s, label))
    adds = []
    add = module.Collected.add
    monkeypatch.setattr(module.Collected, "add", lambda self, df: adds.append(1) or add(self, df))
    side = "concat(s, lpad(i, 5, '0'))"
    nodes = spark.range(rungs).selectExpr("id as i", "explode(array('l', 'r')) as s")
    up = nodes.where(f"i < {rungs - 1}").selectExpr(f"{side} as src", "concat(s, lpad(i + 1, 5, '0')) as dst")
    across = nodes if both_ways else nodes.where("s = 'l'")
    across = across.selectExpr(f"{side} as src", "concat(if(s = 'l', 'r', 'l'), lpad(i, 5, '0')) as dst")
    edges = up.union(across).selectExpr("src", "'activity' as src_kind", "dst", "'activity' as dst_kind")
    g = ProcessGraph(nodes.selectExpr(f"{side} as node", "'activity' as node_kind"), edges)
    middle = rungs // 2 if both_ways else 0
    found = reachable(g, g.nodes.where(f"node = 'l{middle:05d}'")).where("reached").count()
    assert found == 2 * (rungs - middle)
    assert len(adds) + len(stored) < 90


def test_shortcuts_are_ways(spark):
    from tracemill.operators.graph import _jumps

    r = random.Random(4)
    links = sorted({(r.randrange(30), r.randrange(30)) for _ in range(45)})
    reach = {a: {b for x, b in links if x == a} for a in range(30)}
    for _ in range(30):
        reach = {a: s.union(*(reach[b] for b in s)) for a, s in reach.items()}
    jumps = _jumps(spark.createDataFrame(links, "a int, b int"), fan=3).collect()
    assert jumps and all(b in reach[a] for a, b in jumps)


def test_degrees_and_summary(spark):
    g = graph_of(spark, 4, [(0, 1), (0, 2), (1, 2)])
    assert rows(degrees(g), "node", "in_degree", "out_degree") == [
        ("n00", 0, 2), ("n01", 1, 1), ("n02", 2, 0), ("n03", 0, 0)]
    assert tuple(summary(g).first()) == (4, 3)
    assert rows(reachable(graph_of(spark, 2, [(0, 1), (1, 0)])), "reached") == [(False,), (False,)]


def test_activity_named_start_stays_apart(spark):
    g = heuristic_graph(model_of(spark, [["start", "end"]] * 3), 0.5, 1)
    assert g.nodes.count() == 4
    lines = [r["line"] for r in heuristic_dot(g).collect()]
    assert any(line.startswith('\t"start" -> "activity:start"') for line in lines)


def text(spark, path):
    import glob

    files = sorted(glob.glob(f"{path}/part-*"))
    return "".join(open(f).read() for f in files)


def test_heuristic_dot(spark, tmp_path):
    g = heuristic_graph(model_of(spark, [["a", "b"], ["a", 'q"x']] * 2), 0.5, 1)
    write_dot(heuristic_dot(g), str(tmp_path / "dot"))
    assert text(spark, tmp_path / "dot").splitlines() == [
        "digraph {",
        '\t"a" [label="a\\n4" width="2.0" height="0.6666666666666666" shape="box" style="rounded"]',
        '\t"b" [label="b\\n2" width="1.5" height="0.5" shape="box" style="rounded"]',
        '\t"end" [label="end" shape="doublecircle" style="filled" fillcolor="red"]',
        '\t"q\\"x" [label="q\\"x\\n2" width="1.5" height="0.5" shape="box" style="rounded"]',
        '\t"start" [label="start" shape="doublecircle" style="filled" fillcolor="green"]',
        '\t"a" -> "b" [label="2" penwidth="2.0"]',
        '\t"a" -> "q\\"x" [label="2" penwidth="2.0"]',
        '\t"b" -> "end" [penwidth="0.1"]',
        '\t"q\\"x" -> "end" [penwidth="0.1"]',
        '\t"start" -> "a" [penwidth="0.1"]',
        "}",
    ]


def test_fuzzy_dot(spark, tmp_path):
    g = fuzzy_graph(model_of(spark, [["a", "b<c>"], ["a", "d"], ["a", "b<c>"]]), 0.5, 0.2, 0, 0)
    write_dot(fuzzy_dot(g), str(tmp_path / "dot"))
    red = '<br/><font color="red">'
    assert text(spark, tmp_path / "dot").splitlines() == [
        "digraph {",
        f'\t"b<c>" [label=<b&lt;c&gt;{red}0.67</font>> width="2.0" height="0.6666666666666666" shape="box" style="filled" fillcolor="#FDFFF5"]',
        '\t"cluster:d" [label="Cluster 1\\n2 Elements\\n~0.67" width="1.5" height="1.0" shape="octagon" style="filled" fillcolor="#6495ED"]',
        '\t"cluster:d" -> "b<c>" [label="0.67" penwidth="0.1" color="red"]',
        "}",
    ]


def test_save_and_load(spark, tmp_path):
    model = model_of(spark, LOGS["parcel"])
    with pytest.raises(ValueError):
        redraw(model)
    drawn = heuristic_graph(model, 0.2, 2, sizes=False)
    assert model.miner == "heuristic" and model.params == {"dependency": 0.2, "min_frequency": 2.0}
    save_model(model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    assert (back.miner, back.params) == (model.miner, model.params)
    for name in ("activities", "dfg", "starts", "ends"):
        a, b = getattr(model, name), getattr(back, name)
        assert rows(a, *a.columns) == rows(b, *b.columns)
    assert rows(redraw(back, sizes=False).edges, "src", "dst") == rows(drawn.edges, "src", "dst")
    with pytest.raises(Exception):
        save_model(model, str(tmp_path / "m"))
    nodes = rows(fuzzy_graph(back, 0.5, 0.5, edge_cutoff=0.3, sizes=False).nodes, "node")
    save_model(back, str(tmp_path / "m"), overwrite=True)
    again = load_model(spark, str(tmp_path / "m"))
    assert again.miner == "fuzzy" and again.params["edge_cutoff"] == 0.3
    assert rows(redraw(again, sizes=False).nodes, "node") == nodes


def test_a_threshold_reads_only_the_pairs_that_reach_it(spark, tmp_path):
    """Files of pairs hold ranges of dependencies that do not overlap, and the filter reaches their statistics."""
    import pyarrow.parquet as pq

    r = random.Random(3)
    model = model_of(spark, [[r.choice("abcdefghij") for _ in range(r.randint(1, 9))] for _ in range(60)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        save_model(model, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = load_model(spark, str(tmp_path / "m"))
    ranges = []
    for file in (tmp_path / "m").glob("version-*/pairs/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("dependency")
        found = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        ranges += [(x.min, x.max) for x in found]
    ranges.sort()
    assert len(ranges) > 2 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    for threshold in (-0.5, 0.0, 0.3, 0.9):
        fresh, loaded = (dependency_edges(m, threshold, 1) for m in (model, back))
        assert rows(fresh, *fresh.columns) == rows(loaded, *fresh.columns)
        plan = loaded._jdf.queryExecution().toString()
        assert f"GreaterThanOrEqual(dependency,{threshold})" in plan and "Exchange" not in plan
    settings = [HeuristicParams(t, 1) for t in (0.2, 0.4)]
    fresh, loaded = (heuristic_sweep(m, settings) for m in (model, back))
    assert rows(fresh, *fresh.columns) == rows(loaded, *fresh.columns)
    assert "GreaterThanOrEqual(dependency,0.2)" in loaded._jdf.queryExecution().toString()


def test_pairs_of_one_dependency_are_saved_by_several_tasks(spark, tmp_path, monkeypatch):
    from tracemill.sinks import models

    monkeypatch.setattr(models, "TASK_PAIRS", 100, raising=False)
    model = model_of(spark, [[f"a{i}", f"b{i}"] for i in range(2000)] + [["c", "d"]] * 5)  # all but one at 0.5
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        save_model(model, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pairs = load_model(spark, str(tmp_path / "m")).pairs
    sizes = [r["count"] for r in pairs.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 2001 and max(sizes) < 1000
    assert rows(pairs, *pairs.columns) == rows(models.dependencies(model), *pairs.columns)


def test_an_interrupted_save_leaves_the_old_model(spark, tmp_path, monkeypatch):
    """A save that stops between its tables, or just before it is put in force, is as if it had not begun."""
    from tracemill.sinks import models

    path = str(tmp_path / "m")
    old = model_of(spark, LOGS["parcel"])
    save_model(old, path)
    new = model_of(spark, LOGS["shift"])
    broken = model_of(spark, LOGS["shift"])
    broken.starts = broken.starts.selectExpr("activity", "raise_error('stop') AS cases")
    with pytest.raises(Exception, match="stop"):
        save_model(broken, path, overwrite=True)
    with monkeypatch.context() as m:
        m.setattr(models, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stop")))
        with pytest.raises(RuntimeError, match="stop"):
            save_model(new, path, overwrite=True)
    kept = load_model(spark, path)
    assert rows(kept.dfg, *kept.dfg.columns) == rows(old.dfg, *old.dfg.columns)
    for _ in range(3):
        save_model(new, path, overwrite=True)
        now = load_model(spark, path)
        assert rows(now.dfg, *now.dfg.columns) == rows(new.dfg, *new.dfg.columns)
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("version-")]) == 2  # in force, and before it
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))


def test_a_few_nodes_with_one_way_in_cost_no_pass_over_all_edges(spark, monkeypatch):
    """A ladder open both ways: but for its ends, all that merges at first are the two sides."""
    from tracemill import storage

    rungs, stored = 60, []
    monkeypatch.setattr(storage, "new_dir", lambda s, label, f=storage.new_dir: stored.append(label) or f(s, label))
    n = 2 * rungs
    links = [(i, i + 2) for i in range(n - 2)] + [(i, i + 1 - 2 * (i % 2)) for i in range(n)]
    nodes = spark.createDataFrame([(f"n{i:03d}", "k") for i in range(n)], "node string, node_kind string")
    edges = spark.createDataFrame([(f"n{a:03d}", "k", f"n{b:03d}", "k") for a, b in links],
                                  "src string, src_kind string, dst string, dst_kind string")
    got = rows(reachable(ProcessGraph(nodes, edges), nodes.where("node = 'n040'")), "node", "reached")
    assert got == [(f"n{i:03d}", i >= 40) for i in range(n)]
    assert stored.count("links") == 4  # all, those left, sides merged, rungs merged


def test_edges_left_are_told_apart_only_behind_the_origin(spark, monkeypatch):
    from tracemill.operators import graph as module

    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    links = table([("r", "m"), ("r", "n"), ("m", "x"), ("n", "x"), ("n", "y"), ("x", "y"), ("y", "m")], "a string, b string")
    plans = []
    written = module.written
    monkeypatch.setattr(module, "written", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan()) or written(df, label))
    left = module._left(links, table([("r",), ("m",), ("n",)], "a string"), table([("m",), ("n",)], "a string"))
    assert rows(left, "a", "b") == [("", "x"), ("", "y"), ("x", "y")]
    assert "Aggregate [a" not in plans[0].toString()
