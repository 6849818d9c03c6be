"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

CHECKED = [
    "csv_log_comma",
    "dependency_cells_lineitem",
    "directly_follows_words",
    "fuzzy_node_significance",
    "fuzzy_sweep_edges",
    "fuzzy_utility_bounds",
    "heuristic_graph_edges_words_05_2",
    "heuristic_sweep_banded",
    "ordered_events_lineitem",
    "reachable_words",
    "saved_model_read_back",
    "trace_file_comma",
    "traces_orders",
    "vocabulary_by_first_seen_words",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def comparable(row):
    return tuple((v is None, str(type(v)), 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted(got, key=comparable) == sorted(want, key=comparable)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("one_task_rows", [100, 0])
@pytest.mark.parametrize("keys", [range(0, 30, 3), range(1, 12), [5, 2, 2, 9, 9, 9, 4], [7, None, 1, 3, 8], [None], []])
def test_the_ladder_starts_at_the_median_without_all_keys_in_one_task(spark, tmp_path, monkeypatch, keys, one_task_rows):
    keys = list(keys)
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(entry.ranked, "__defaults__", ((), one_task_rows))
    roots, reachable = [], entry.tm.reachable
    monkeypatch.setattr(entry.tm, "reachable", lambda g, r: roots.append(r) or reachable(g, r))
    got = [tuple(r) for r in entry.queries()["reachable_ladder_orders"](spark, str(tmp_path)).collect()]
    distinct = sorted({k for k in keys if k is not None})
    middle = distinct[(len(distinct) + 1) // 2 - 1] if distinct else None
    want = [(str(s * k), "activity", k >= middle) for k in distinct for s in (1, -1)]
    want += [(None, "activity", False)] * (2 * (None in keys))
    assert sorted(got, key=comparable) == sorted(want, key=comparable)
    assert "percentile" not in roots[0]._jdf.queryExecution().toString()  # it holds each distinct key in the one task that ends it
