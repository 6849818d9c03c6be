import random
from collections import Counter

import pytest

from fixtures import LOGS, model_of, rows
from tracemill import FuzzyBase, FuzzyParams, FuzzyRun, correlation, fuzzy_graph, outgoing
from tracemill.operators.leaders import clusters
from tracemill.plans import fuzzy

@pytest.fixture(scope="module")
def bases(spark):
    return {name: FuzzyBase(model_of(spark, traces)) for name, traces in LOGS.items()}


@pytest.mark.parametrize("known,label_bytes", [(0, 256), (2, 256), (200_000, 256), (200_000, 4), (200_000, 0)])
def test_correlation_whoever_is_known(bases, monkeypatch, known, label_bytes):
    monkeypatch.setattr(fuzzy, "KNOWN", known)
    monkeypatch.setattr(fuzzy, "LABEL_BYTES", label_bytes)
    for name, traces in LOGS.items():
        steps = Counter(p for t in traces for p in zip(t, t[1:]))
        total = Counter(a for t in traces for a in t[:-1])
        want = sorted((a, b, n, float(f"{n / total[a]:.2f}")) for (a, b), n in steps.items())
        assert rows(correlation(bases[name].model), "src", "dst", "cnt", "corr") == want


def test_only_few_sources_are_known(bases, monkeypatch):
    totals = outgoing(bases["shift"].model)
    n = {a: t for a, t in rows(totals, "src", "total")}
    monkeypatch.setattr(fuzzy, "KNOWN", 2)
    found = dict(rows(fuzzy._frequent(totals), "src", "total"))
    assert 0 < len(found) <= 2 and min(found.values()) > max(t for a, t in n.items() if a not in found)
    plan = correlation(bases["shift"].model)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # their pairs stay where they are read


def test_known_significance(bases):
    # book, pack, and send occur six times each, sign four times, back once
    found = dict(rows(bases["parcel"].nodes, "activity", "sig"))
    assert (found["pack"], found["send"], found["sign"], found["back"]) == (1.0, 1.0, 0.67, 0.17)


def test_only_activity_is_removed(spark):
    run = FuzzyRun(FuzzyBase(model_of(spark, [["a", "a"], ["a"]])), [FuzzyParams()])
    assert rows(run.removed, "activity") == [("a",)]
    assert run.graph(sizes=False).nodes.count() == 0


def test_graph_of_one_setting(bases):
    g = fuzzy_graph(bases["shift"].model, 0.9, 0.3, 0.4, 0.5)
    _, _, owner, mean_sig, *_ = brute(LOGS["shift"], 0.9, 0.3, 0.4, 0.5)
    found = {r["node"]: r for r in g.nodes.where("node_kind = 'cluster'").collect()}
    assert {k: (r["size"], r["sig"]) for k, r in found.items()} == mean_sig and len(found) > 0
    assert [found[k]["number"] for k in sorted(found)] == list(range(1, len(found) + 1))
    plain = {r["node"] for r in g.nodes.where("node_kind = 'activity'").collect()}
    assert not plain & set(owner)
    assert (g.edges.select("penwidth").distinct().collect() or [(0.1,)])[0][0] == 0.1


# -- against the definitions, pair by pair ------------------------------------


def brute(traces, g, c, e, u):
    """The whole miner on dictionaries of all pairs, straight from its definition."""
    freq = Counter(a for t in traces for a in t)
    steps = Counter(p for t in traces for p in zip(t, t[1:]))
    names = sorted(freq)
    out = Counter()
    for (a, _), n in steps.items():
        out[a] += n
    sig = {a: float(format(freq[a] / max(freq.values()), ".2f")) for a in names}
    corr = {
        (a, b): float(format(steps[a, b] / out[a], ".2f")) if steps[a, b] and a != b else 0.0
        for a in names for b in names
    }
    weak = {
        a for a in names
        if all(corr[a, b] < c and corr[b, a] < c and sig[a] < g for b in names if b != a)
    }
    live = [a for a in names if a not in weak]

    util = {}
    for a in live:
        for b in live:
            if a != b:
                raw = sig[a] * u + (1 - u) * corr[a, b]
                util[a, b] = round_half_even(raw) if (u, e) != (0, 0) else 0.0
    norm = {}
    for a, b in util:
        column = [v for (x, y), v in util.items() if y == b]
        low = min((v for v in column if v), default=None)
        value = 0.0
        if low is not None and util[a, b] != low and max(column + [0.0]) != low:
            value = round_half_even((util[a, b] - low) / (max(column + [0.0]) - low))
        norm[a, b] = value if value >= e and value > 0 and corr[a, b] > 0 else 0.0
    filtered = {p for p in norm if corr[p] > 0 and norm[p] == 0} if any(norm.values()) else set()

    owner = {}
    for s in live:
        if sig[s] < g and s not in owner:
            owner[s] = s
            for x in live:
                if x not in owner and (corr[s, x] >= c or corr[x, s] >= c):
                    owner[x] = s
    mean_sig = {}
    for s in sorted(set(owner.values())):
        group = [a for a in live if owner.get(a) == s]
        total = sum(round(sig[a] * 100) for a in group)
        mean_sig[s] = (len(group), float(format(total / 100 / len(group), ".2f")))

    sums = {}
    for a in live:
        for b in live:
            x, y = (owner.get(a), a not in owner), (owner.get(b), b not in owner)
            if a == b or corr[a, b] <= 0 or (a in owner and b in owner and owner[a] == owner[b]):
                continue
            if a not in owner and b not in owner and (a, b) in filtered:
                continue
            ends = (owner.get(a, a), "C" if a in owner else "N", owner.get(b, b), "C" if b in owner else "N")
            sums.setdefault(ends, []).append(corr[a, b])
    edges = {}
    for ends, values in sums.items():
        total = sum(round(v * 100) for v in values)
        edges[ends] = round_half_even(total / 100 / len(values)) if "C" in ends[1::2] else values[0]
    return weak, filtered, owner, mean_sig, edges, util, norm


def round_half_even(x):
    import numpy as np

    return float(np.round(x, 2))


@pytest.mark.parametrize("seed", range(3))
def test_against_definition(spark, seed):
    r = random.Random(seed)
    names = [f"{x}{y}" for x in "abcdef" for y in "12"]
    weights = [r.random() ** 3 + 0.01 for _ in names]
    traces = [r.choices(names, weights, k=r.randint(1, 9)) for _ in range(60)]
    params = [FuzzyParams()]
    for _ in range(12):
        params.append(FuzzyParams(*[round(r.random() * m, 2) for m in (1, 0.6, 1, 1)]))
    params += [FuzzyParams(0.5, 0.3, 0.4, 0.0), FuzzyParams(0.5, 0.0, 0.2, 1.0),
               FuzzyParams(1.0, 0.2, 0.0, 0.3), FuzzyParams(0.2, 1.0, 1.0, 1.0)]
    check(spark, FuzzyBase(model_of(spark, traces)), traces, params)


@pytest.mark.parametrize("name", LOGS)
def test_small_logs_against_definition(spark, bases, name):
    settings = [(0, 0, 0, 0), (0.5, 0.5, 0, 0), (0.6, 0.6, 0.4, 0.5), (0.9, 0.3, 0.4, 0.5), (0, 0, 0.4, 0.5)]
    check(spark, bases[name], LOGS[name], [FuzzyParams(*p) for p in settings])


def check(spark, base, traces, params):
    run = FuzzyRun(base, params)
    removed = rows(run.removed, "param_id", "activity")
    filtered = rows(run.filtered, "param_id", "src", "dst")
    owner = rows(run.clusters, "param_id", "activity", "leader")
    sig = rows(run.cluster_nodes, "param_id", "leader", "size", "sig")
    names = rows(run.cluster_names, "param_id", "leader", "position", "activity")
    edges = run.edges.collect()
    normed = rows(run.normalised, "param_id", "src", "dst", "util", "norm")
    letter = {"activity": "N", "cluster": "C"}
    for i, p in enumerate(params):
        weak, cut, own, mean_sig, expected, util, norm = brute(
            traces, p.significance, p.correlation, p.edge_cutoff, p.utility_ratio)
        assert {a for q, a in removed if q == i} == weak
        assert {(a, b) for q, a, b in filtered if q == i} == cut
        assert {a: s for q, a, s in owner if q == i} == own
        assert {s: (n, v) for q, s, n, v in sig if q == i} == mean_sig
        groups = {s: sorted(a for a in own if own[a] == s) for s in own.values()}
        assert [x[1:] for x in names if x[0] == i] == sorted(
            (s, k, a) for s, group in groups.items() for k, a in enumerate(group, 1))
        for q, a, b, v, n in normed:
            if q == i:
                assert (v, n) == (util[a, b], norm[a, b])
        found = {(x.src, letter[x.src_kind], x.dst, letter[x.dst_kind]): x.value
                 for x in edges if x.param_id == i}
        assert found == expected


def sequential(nodes, seeds, links):
    near = {n: set() for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    owner = {}
    for s in sorted(seeds):
        if s not in owner:
            owner[s] = s
            for x in near[s]:
                owner.setdefault(x, s)
    return owner


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_against_sequential_rule(spark, seed):
    r = random.Random(seed)
    graphs, seed_rows, link_rows = [], [], []
    for i in range(25):
        nodes = [f"n{k:02d}" for k in range(r.randint(1, 14))]
        seeds = [n for n in nodes if r.random() < 0.7]
        links = [(a, b) for a in nodes for b in nodes if a != b and r.random() < 0.12]
        graphs.append((nodes, seeds, links))
        seed_rows += [(i, s) for s in seeds]
        link_rows += [(i, a, b) for a, b in links]
    # A chain in label order is the longest dependence there is.
    chain = [f"n{k:02d}" for k in range(12)]
    graphs.append((chain, chain, list(zip(chain, chain[1:]))))
    seed_rows += [(25, s) for s in chain]
    link_rows += [(25, a, b) for a, b in zip(chain, chain[1:])]
    found = clusters(
        spark.createDataFrame(seed_rows, "param_id long, activity string"),
        spark.createDataFrame(link_rows, "param_id long, a string, b string"),
    )
    got = rows(found, "param_id", "activity", "leader")
    for i, g in enumerate(graphs):
        assert {a: s for p, a, s in got if p == i} == sequential(*g)


def test_a_sweep_stores_each_outcome_once(spark, bases):
    """Of 101 neighbouring settings, links are stored once per set of live nodes and outcomes once per outcome."""
    base, traces = bases["parcel"], LOGS["parcel"]
    params = [FuzzyParams(0.6, c / 100, 0.4, 0.5) for c in range(101)]
    params += [FuzzyParams(0.6, 0.3, e / 50, 0.5) for e in range(51)]
    run = FuzzyRun(base, params)
    live = {i: frozenset() for i in range(len(params))}
    for i, activity in rows(run.live, "param_id", "activity"):
        live[i] |= {activity}
    assert len(run._link_members) <= len(set(live.values())) < 10
    assert len(run._members) < 80
    stored = run._links.scaled.groupBy("param_id").count().count()
    assert stored <= len(run._link_members)
    some = [0, 1, 17, 30, 31, 55, 100, 101, 121, 122, 151]
    edges = rows(run.edges, "param_id", "src", "src_kind", "dst", "dst_kind", "value", "links")
    for i in some[::3]:
        alone = rows(FuzzyRun(base, [params[i]]).edges, "src", "src_kind", "dst", "dst_kind", "value", "links")
        assert [e[1:] for e in edges if e[0] == i] == alone
    owner = rows(run.clusters, "param_id", "activity", "leader")
    for i in some:
        p = params[i]
        own = brute(traces, p.significance, p.correlation, p.edge_cutoff, p.utility_ratio)[2]
        assert {a: s for q, a, s in owner if q == i} == own


@pytest.mark.parametrize("frequent", [1, 200_000])
def test_pairs_that_come_to_nothing_are_left_out(spark, monkeypatch, frequent):
    """Most pairs of a frequent activity have correlation 0.00; graphs are those of the definition, found without them."""
    monkeypatch.setattr("tracemill.plans.fuzzy.FREQUENT", frequent)  # with 1, no source is known to every task
    traces = [["hub", f"n{i % 40}", "hub"] for i in range(250)] + [["hub", f"m{i:02}", "end"] for i in range(40)]
    traces += [["hub", "end", "end"]] * 30 + [["n1", "n2", "m01"]] * 3
    base = FuzzyBase(model_of(spark, traces))
    params = [
        FuzzyParams(0.05, 0.3, 0.2, 0.5), FuzzyParams(0.3, 0.5, 0.4, 0.0), FuzzyParams(0.0, 0.0, 0.0, 0.0),
        FuzzyParams(0.02, 0.6, 0.7, 0.9), FuzzyParams(0.5, 0.0, 0.3, 0.4), FuzzyParams(1.0, 1.0, 1.0, 1.0),
    ]
    run = FuzzyRun(base, params)
    assert run.edges.count() > 0
    assert "pairs" not in vars(base)
    assert 0 < base.felt.count() == base.pairs.where("corr > 0").count() < base.pairs.count()
    check(spark, base, traces, params)
