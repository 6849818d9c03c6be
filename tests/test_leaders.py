"""Leaders against the greedy definition, and how many tables long chains take."""

import random

import pytest

from tracemill.operators.leaders import leaders
from tracemill.storage import app_dir

SEEDS = "param_id int, activity string"
LINKS = "param_id int, a string, b string"


def greedy(nodes, links):
    near = {n: set() for n in nodes}
    for a, b in links:
        if a in near and b in near and a != b:
            near[a].add(b)
            near[b].add(a)
    lead = set()
    for n in sorted(nodes):
        if not near[n] & lead:
            lead.add(n)
    return lead


def stored(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(app_dir(spark))
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def shapes(seed):
    rnd = random.Random(seed)
    n = 60
    yield [(i, i + 1) for i in range(n - 1)]  # a chain
    yield [(i // 2, i) for i in range(1, n)]  # a tree
    yield [(i, i + k) for i in range(n - 2) for k in (1, 2)]  # everyone waits for two
    yield [(rnd.randrange(n), rnd.randrange(n)) for _ in range(45)]
    yield [(rnd.randrange(n), rnd.randrange(n)) for _ in range(120)]
    yield [(0, i) for i in range(1, n)]  # a star
    yield [(i, i + 1) for i in range(0, 40)] + [(3, 20), (7, 31), (50, 51), (51, 50), (9, 9)]  # chains that meet
    yield []


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_are_the_greedy_ones(spark, seed):
    names = [f"n{i:03d}" for i in range(60)]
    random.Random(seed).shuffle(names)
    if seed == 1:
        names.sort()
    seeds, links, want = [], [], set()
    for param, shape in enumerate(shapes(seed)):  # all at once: settings never mix
        nodes = names if param % 2 else names[:55]
        seeds += [(param, n) for n in nodes]
        links += [(param, names[a], names[b]) for a, b in shape]
        want |= {(param, n) for n in greedy(nodes, [(names[a], names[b]) for a, b in shape])}
    got = leaders(spark.createDataFrame(seeds * 2, SEEDS), spark.createDataFrame(links, LINKS)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_chain_takes_few_tables(spark):
    n = 10_000
    seeds = spark.range(n).selectExpr("0 AS param_id", "lpad(CAST(id AS STRING), 6, '0') AS activity")
    links = spark.range(1, n).selectExpr(
        "0 AS param_id", "lpad(CAST(id - 1 AS STRING), 6, '0') AS a", "lpad(CAST(id AS STRING), 6, '0') AS b"
    )
    before = stored(spark)
    got = {r.activity for r in leaders(seeds, links).collect()}
    assert got == {f"{i:06d}" for i in range(0, n, 2)}
    assert stored(spark) - before < 40


def test_a_chain_of_neighbours_is_followed_in_its_tasks(spark):
    """Seeds that wait for the one before them are resolved where they lie; no table for every doubling of the way."""
    n = 10_000
    seeds = spark.range(n).selectExpr("0 AS param_id", "lpad(CAST(id AS STRING), 6, '0') AS activity")
    links = seeds.selectExpr("param_id", "activity AS a", "lpad(CAST(activity + 1 AS BIGINT), 6, '0') AS b")
    before = stored(spark)
    assert leaders(seeds, links).count() == n // 2
    assert stored(spark) - before < 12


def test_no_seeds(spark):
    assert leaders(spark.createDataFrame([], SEEDS), spark.createDataFrame([(0, "a", "b")], LINKS)).count() == 0
