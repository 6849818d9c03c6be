"""Ends of pointers against following them one by one, and how few tables a long way takes."""

import random

import pytest

from tracemill import ProcessGraph, reachable, storage
from tracemill.operators import forest
from tracemill.operators.forest import ends_of


def followed(pointers):
    found = {}
    for a in pointers:
        at, flip, steps = a, False, 0
        while at in pointers and steps <= len(pointers):
            at, turned = pointers[at]
            flip, steps = flip != turned, steps + 1
        found[a] = (None, None) if steps > len(pointers) else (at, flip)
    return found


@pytest.mark.parametrize("task_rows", [7, 1000])
@pytest.mark.parametrize("shape", ["chain", "shuffled chain", "trees", "closed", "none"])
def test_ends(spark, shape, task_rows):
    r, n = random.Random(task_rows), 60
    names = [f"n{i:03d}" for i in range(n)]
    if shape != "chain":
        r.shuffle(names)
    to = {
        "chain": lambda i: i - 1, "shuffled chain": lambda i: i - 1, "trees": lambda i: r.randrange(i),
        "closed": lambda i: r.randrange(n), "none": lambda i: i,
    }[shape]
    pointers = {names[i]: (names[to(i)], r.random() < 0.5) for i in range(1, n) if shape != "none"}
    table = spark.createDataFrame([(a, p, f) for a, (p, f) in pointers.items()], "a string, p string, flip boolean")
    got = {x.a: (x.p, x.flip if x.p is not None else None) for x in ends_of(table, task_rows).collect()}
    assert got == followed(pointers)


def test_a_long_way_is_followed_in_few_tables(spark, monkeypatch):
    """Ways along neighbouring names, and both sides of a ladder, are merged where they lie, not doubled step by step."""
    stored = []
    monkeypatch.setattr(storage, "new_dir", lambda s, label, f=storage.new_dir: stored.append(label) or f(s, label))
    monkeypatch.setattr(forest.ends_of, "__defaults__", (500,))
    n = 5000
    nodes = spark.range(n).selectExpr("explode(array(concat('n', lpad(id, 6, '0')), concat('m', lpad(id, 6, '0')))) as node")
    name = "concat(s, lpad(id{0}, 6, '0'))"
    sides = spark.range(n).selectExpr("id", "explode(array('m', 'n')) as s")
    up = sides.where(f"id < {n - 1}").selectExpr(name.format(""), name.format(" + 1"))
    across = sides.selectExpr(name.format(""), "concat(translate(s, 'mn', 'nm'), lpad(id, 6, '0'))")
    edges = up.union(across).toDF("src", "dst").selectExpr("src", "'k' as src_kind", "dst", "'k' as dst_kind")
    g = ProcessGraph(nodes.selectExpr("node", "'k' as node_kind"), edges)
    reached = reachable(g, g.nodes.where("node = 'm002000'")).where("reached")
    assert reached.count() == 2 * (n - 2000) and reached.where("substring(node, 2) < '002000'").isEmpty()
    assert len(stored) < 30
