"""Text operators over whole tables: near copies, vectors, packing, shards, mixing, pipeline."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tracemill.llm import common, mixing, packing, prefix, sharding, simhash, vectors, word_bpe  # noqa: E402
from tracemill.llm.components import components  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def smallest_reachable(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rnd = random.Random(3)
    edges = {
        "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(5, 5), (1, 2), (2, 1)],
        "path": [(i, i + 1) for i in range(120)],
        "star": [(900, i) for i in range(100)],
        "none": [],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == smallest_reachable({x for e in real for x in e}, real)


# -- near copies ---------------------------------------------------------------------------


def near(prints, bits=3):
    return [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= bits]


def some_prints(seed, n=250):
    """Random fingerprints, each with a few close ones, and a crowd around one of them."""
    rnd = random.Random(seed)
    out = {0}
    for _ in range(n // 5):
        x = rnd.getrandbits(64)
        out |= {x} | {x ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 2, 3, 4)}
    centre = rnd.getrandbits(64)
    out |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for _ in range(80)}
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_links_are_all_pairs(spark, seed):
    prints = some_prints(seed)
    df = spark.createDataFrame([(signed(x),) for x in prints], "x long")
    got = {tuple(sorted(r)) for r in simhash.links(df).collect()}
    assert got == {tuple(sorted(map(signed, pair))) for pair in near(prints)}


def test_simhash_crowded_cells_connect_the_same(spark):
    prints = some_prints(7, 100)
    df = spark.createDataFrame([(signed(x),) for x in prints], "x long")
    hubs = [(r.a, r.b) for r in simhash.links(df, cell_rows=1).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in hubs)
    nodes = [signed(x) for x in prints]
    pairs = [tuple(map(signed, p)) for p in near(prints)]
    assert smallest_reachable(nodes, hubs) == smallest_reachable(nodes, pairs)


def plain_print(text):
    import xxhash

    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = low.split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


NEAR_TEXTS = [
    (1, "The quick brown fox"), (2, "the QUICK brown fox"), (3, None), (4, ""), (5, " \n"), (6, "one"),
    (7, "one two"), (8, "École ÉCOLE école " * 40), (9, "a b c " * 900), (9, "a b c " * 900),
    (None, "the quick brown fox"), (None, None), (12, " ".join(f"w{i}" for i in range(400))),
    (11, " ".join(f"w{i}" for i in range(400)) + " tail"), (13, "x" * 3000),
]


def test_near_duplicates_of_odd_rows(spark, monkeypatch):
    rows = [(i, t, None, 5) for i, t in NEAR_TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, kept_id int")
    got = simhash.near_duplicates(df).collect()
    prints = [plain_print(t) for _, t in NEAR_TEXTS]
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter(
        (i, f"{p:016x}") for (i, _), p in zip(NEAR_TEXTS, prints, strict=True)
    )
    roots = smallest_reachable(set(prints), near(sorted(set(prints))))
    first = {}
    for (i, _), p in zip(NEAR_TEXTS, prints, strict=True):
        if i is not None:
            first[roots[p]] = min(i, first.get(roots[p], i))
    assert all(r.component_id == first.get(roots[int(r.fingerprint, 16)]) for r in got)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_rows_of_one_id_are_judged_by_their_text(spark):
    """Of each group one row stays, also where ids repeat or are missing."""

    def say(k):
        return " ".join(f"{k}w{i}" for i in range(200))

    rows = [
        (1, say("a")), (2, say("b")), (2, say("a")), (3, say("c")), (3, say("d")), (3, say("d")),
        (None, say("e")), (None, say("e") + " "), (None, say("c")), (None, say("f")), (4, say("f").upper()),
    ]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string")).collect()
        got = sorted((r.doc_id or 0, r.text.strip().lower()) for r in kept)
        assert got == [(0, say("e")), (1, say("a")), (2, say("b")), (3, say("c")), (3, say("d")), (4, say("f"))]


def test_fingerprints_do_not_depend_on_pieces(monkeypatch):
    from tracemill.llm import common

    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(common, "PIECE_BYTES", 7)
    assert simhash.fingerprint(text) == want


# -- vectors -------------------------------------------------------------------------------


def some_vectors(seed=5):
    rnd = np.random.default_rng(seed)
    rows = []
    for group in (1, 1, 2, 5, 40, 90):
        centre = rnd.standard_normal(16)
        rows += [(centre + 0.1 * rnd.standard_normal(16)).tolist() for _ in range(group)]
    start, turn = rnd.standard_normal(16), rnd.standard_normal(16)
    start, turn = start / np.linalg.norm(start), turn / np.linalg.norm(turn)
    turn -= (turn @ start) * start
    turn /= np.linalg.norm(turn)
    rows += [(np.cos(0.2 * k) * start + np.sin(0.2 * k) * turn).tolist() for k in range(14)]  # a chain
    rows += [rows[0], rows[0], [1e200] * 16, [1e-200] * 16]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    return list(enumerate(rows + odd)) + [(None, rows[3])]


def valid(v):
    return bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)


@pytest.mark.parametrize("block", [7, 1024])
def test_vectors_against_all_pairs(spark, block):
    rows = some_vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = vectors.near_duplicate_vectors(df, block=block).collect()
    unit = {}
    for k, (_, v) in enumerate(rows):
        if valid(v):
            x = np.array(v) / np.abs(v).max()
            unit[k] = x / np.linalg.norm(x)
    pairs = [
        (a, b) for a in unit for b in unit if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9
    ]
    degree = collections.Counter(x for p in pairs for x in p)
    roots = smallest_reachable(range(len(rows)), pairs)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[roots[k]] = min(i, first.get(roots[k], i))
    want = sorted((repr(i), degree[k], first.get(roots[k]), i == first.get(roots[k])) for k, (i, _) in enumerate(rows))
    assert sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == want
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    noise = F.transform("embedding", lambda x: x + F.rand(3) * 0.02)
    both = df.unionByName(df.withColumn("vec_id", F.col("vec_id") + 10_000).withColumn("embedding", noise))
    found = {r.vec_id: r for r in vectors.near_duplicate_vectors(both).collect()}
    assert len(found) == both.count()
    pairs = both.alias("a").join(both.alias("b"), F.expr("b.vec_id = a.vec_id + 10000"))
    rows = pairs.select(F.col("a.vec_id"), F.col("a.embedding").alias("x"), F.col("b.embedding").alias("y")).collect()
    close = [
        r.vec_id for r in rows
        if np.dot(r.x, r.y) / np.linalg.norm(r.x) / np.linalg.norm(r.y) >= 0.9
    ]
    assert len(close) > 400
    assert sum(found[i + 10_000].component_id <= i and found[i].n_links >= 1 for i in close) > 0.97 * len(close)


def pair_among_copies(dim, copies):
    """y and z at a cosine of 0.92, and on the way from one to the other copies of x at 0.8 to both."""
    base = np.linalg.qr(np.random.default_rng(2).standard_normal((dim, dim)))[0]
    half = float(np.arccos(0.92)) / 2
    y, z = (np.cos(half) * base[0] + s * np.sin(half) * base[1] for s in (1, -1))
    tilt = 0.8 / np.cos(half)
    x = tilt * base[0] + np.sqrt(1 - tilt**2) * base[2]
    return [v.tolist() for v in (y, z, *[x] * copies)]


def test_copies_of_a_vector_take_no_window(spark):
    rows = [(1000 * dim + i, v) for dim in range(8, 24) for i, v in enumerate(pair_among_copies(dim, 40))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {r.vec_id: r for r in vectors.near_duplicate_vectors(df, passes=1, window=2).collect()}
    for first in range(8000, 24_000, 1000):
        found = [(got[first + i].component_id - first, got[first + i].n_links) for i in (0, 1, 2, 41)]
        assert found == [(0, 1), (0, 1), (2, 39), (2, 39)]


def test_passes_follow_the_number_of_vectors():
    counts = [vectors.planned_passes(n) for n in (0, 1, 14_000, 1_000_000, 10_000_000)]
    assert counts[:3] == [20, 20, 20] and 40 < counts[3] < counts[4] < 120


# -- packing -------------------------------------------------------------------------------


def plain_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 100])
    lengths = [min(capacity, 1 + int(rnd.expovariate(4 / capacity))) for _ in range(rnd.choice([1, 30, 900]))]
    histogram = collections.Counter(lengths)
    used, seen = collections.defaultdict(list), collections.Counter()
    for length, first, end, each, sequence, offset in packing.best_fit_plan(histogram.items(), capacity):
        assert first == seen[length]
        seen[length] = end
        for k in range(end - first):
            used[sequence + k // each].append((offset + k % each * length, length))
    assert seen == histogram
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, capacity)


def test_packed_round_trip(spark):
    texts = [None, "", "a b c", "one two three " * 700, "word " * 4095, "word " * 4096, "x", "x"]
    rows = [(i if i < 7 else 6, t, 1, "s") for i, t in enumerate(texts)] + [(None, "null id", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, rank_ string")
    bpe = word_bpe.load(VOCABULARY)
    for capacity in (4096, 100):
        got = packing.packed(df, VOCABULARY, capacity, with_ids=True).collect()
        per_sequence, per_doc = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.start == r.piece * capacity
            per_sequence[r.sequence_id].append((r.offset, r.length))
            per_doc[r.doc_id].append((r.piece, bytes(r.ids)))
        for places in per_sequence.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        for i, text, *_ in rows:
            ids = bpe.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
            data = b"".join(n.to_bytes(4, "little") for n in ids)
            found = b"".join(x for _, x in sorted(per_doc[i]))
            assert found == (data * 2 if i == 6 else data)
        lengths = [r.length for r in got]
        assert len(per_sequence) == len(plain_best_fit(lengths, capacity))
    assert packing.packed(df.limit(0), VOCABULARY).count() == 0


# -- shards and running totals ---------------------------------------------------------------


def test_running_totals(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "b"]), i, rnd.randrange(9), 0) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, n long, part int")
    got = prefix.running_totals(df, ["k"], {"before": F.col("n")}, ["g"])
    assert got.columns == ["g", "k", "n", "part", "before"]
    for r in got.collect():
        assert r.before == sum(n for g, k, n, _ in rows if g == r.g and k < r.k)


def test_shards(spark):
    rnd = random.Random(2)
    rows = [(i, "é" * rnd.randrange(200), 1) for i in range(400)]
    rows += [(None, "null id", 1), (7, None, 1), (7, "", 1), (7, "again", 1), (7, "again", 1), (500, "y" * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_by_bytes(df, 5).collect()
    assert len(got) == len(rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    sizes = collections.Counter()
    for shard in range(5):
        part = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        sizes[shard] = sum(r.size for r in part)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    total, largest = sum(sizes.values()), max(r.size for r in got)
    assert total == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert {(r.doc_id, r.text_crc32) for r in got} == {(i, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


# -- mixing --------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + share * weight[s] >= 3 * sizes[s]}
        for s in full or open_:
            gain = 3 * sizes[s] - target[s] if full else share * weight[s]
            target[s] += gain
            left -= gain
        open_ -= full
        if not full:
            break
        # what the full ones took is settled; share the rest anew
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in set(sizes) - open_)
        for s in open_:
            target[s] = 0.0
    return target


def mix_rows(seed=4):
    rnd = random.Random(seed)
    rows = [(i, "w " * rnd.randrange(40), rnd.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(600)]
    rows += [(700 + i, "w " * 30, "hot") for i in range(900)]
    rows += [(2000, "tiny x", "zz"), (2001, None, "zz"), (2002, "", "empty"), (None, "a b", "a"), (5, "x y z", "a"), (5, "x y z", "a")]
    return rows


def test_mixture(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, size int, row string")
    got = mixing.mixture(df, n_shards=5).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(sizes)
    by_text = collections.defaultdict(set)
    for i, text, source in rows:
        by_text[i].add((len((text or "").split()), sizes[source], source))
    taken, targets, largest = collections.Counter(), {}, collections.Counter()
    for r in got:
        (source,) = [s for n, total, s in by_text[r.doc_id] if (n, total) == (r.size, r.source_size)]
        taken[source] += r.taken
        targets[source] = r.target
        largest[source] = max(largest[source], r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    for source in sizes:
        assert targets[source] == pytest.approx(want[source])
        assert abs(taken[source] - targets[source]) <= largest[source]
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mixture(df.repartition(7), n_shards=5).collect()
    key = lambda r: (repr(r.doc_id), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mixture(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mixture(df.where("text = ''")).collect()} <= {0}


def exact_totals(low, high, total):
    """Blocks of all sources that each shard gets, by halving the shards."""
    if high - low == 1:
        return [total]
    middle = (low + high + 1) // 2
    left = total * (middle - low) // (high - low)
    return exact_totals(low, middle, left) + exact_totals(middle, high, total - left)


@pytest.mark.parametrize("shards", [3, 8])
def test_the_tree_deals_every_block_to_one_shard(spark, shards):
    """Blocks of a source are disjoint between shards, and every shard gets its exact quota of all blocks."""
    rnd = random.Random(shards)
    rows = [(i, i, rnd.choice(["a", "a", "b", "c", None]), rnd.randrange(1, 9)) for i in range(6000)]
    df = spark.createDataFrame(rows, "row long, id long, source string, size long")
    uses = mixing.schedule(df, n_shards=shards, seed=5).collect()
    home, words = collections.defaultdict(set), collections.Counter()
    for r in uses:
        assert (r["pass"] is None) == (r.block is None) == (r.shard is None) == (r.place is None)
        if r.block is not None:
            home[r.source, r.block].add(r.shard)
            words[r.source] += r.size
    assert all(len(s) == 1 for s in home.values())
    for source in {r[2] for r in rows}:  # a source's blocks are all there, and cut across shards
        blocks = sorted(b for s, b in home if s == source)
        assert blocks == list(range(len(blocks))) and len({min(home[source, b]) for b in blocks}) == shards
    got = collections.Counter(min(s) for s in home.values())
    assert [got[i] for i in range(shards)] == exact_totals(0, shards, len(home))
    found = mixing.mixture(df.selectExpr("id AS doc_id", "repeat('w ', CAST(size AS INT)) AS text", "source"), n_shards=shards, seed=5)
    assert sum(r.taken for r in found.collect()) == sum(words.values())


@pytest.mark.parametrize("shards", [2, 6])
def test_what_the_tree_does_not_deal_is_not_taken(spark, shards, monkeypatch):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    whole = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a, **k: whole(*a, **k).where("shard > 0"))
    part = sum(r.taken for r in mixing.mixture(df, n_shards=shards).collect())
    monkeypatch.setattr(mixing, "split_quotas", whole)
    assert 0 < part < sum(r.taken for r in mixing.mixture(df, n_shards=shards).collect())


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_quotas_are_split_exactly(spark, shards):
    blocks = {0: 1, 1: 40, 2: 300, 3: 0, 4: 7}
    quotas = spark.createDataFrame(list(blocks.items()), "number long, blocks long")
    got = collections.defaultdict(list)
    for r in mixing.split_quotas(quotas, shards, seed=3).collect():
        got[r.number].append((r.shard, r.before, r.blocks))
    per_shard = collections.Counter()
    for number, parts in got.items():
        parts.sort()
        assert [s for s, _, _ in parts] == list(range(shards))
        assert sum(b for _, _, b in parts) == blocks[number] and all(b >= 0 for _, _, b in parts)
        assert [a for _, a, _ in parts] == [sum(b for _, _, b in parts[:k]) for k in range(shards)]
        for s, _, b in parts:
            per_shard[s] += b
    assert max(per_shard.values()) - min(per_shard.values()) <= 3


def test_drawn_quotas_follow_the_hypergeometric_mean(spark):
    draws = spark.range(4000).select(
        mixing._drawn(
            F.lit(400).cast("long"), F.lit(100).cast("long"), F.lit(160).cast("long"),
            mixing._uniform(F.lit(1), F.col("id")),
        ).alias("k")
    )
    mean, deviation = draws.agg(F.avg("k"), F.stddev("k")).first()
    assert mean == pytest.approx(40, abs=0.4)
    assert deviation == pytest.approx((160 * 0.25 * 0.75 * 240 / 399) ** 0.5, rel=0.06)


def test_mixed_rows_are_the_scheduled_ones(spark):
    rows = mix_rows(9)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mix_row int")
    taken = {(repr(r.doc_id), r.size): r.taken for r in mixing.mixture(df, n_shards=4).collect()}
    mix = mixing.mixed(df, n_shards=4)
    assert mix.columns[:4] == df.columns
    got = collections.Counter()
    shards = collections.Counter()
    for r in mix.collect():
        got[repr(r.doc_id), len((r.text or "").split())] += len((r.text or "").split())
        shards[r.mix_shard] += len((r.text or "").split())
    for k, words in got.items():
        if k[0] != "5":
            assert taken[k] == words
    assert set(shards) == {0, 1, 2, 3} and max(shards.values()) < 1.35 * min(shards.values())


# -- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [docs.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and len(counts) == 6
    deduped = spark.read.parquet(str(tmp_path / "2"))
    prints = [int(r.fingerprint, 16) for r in simhash.near_duplicates(deduped).collect()]
    assert not near(prints)
    before = spark.read.parquet(str(tmp_path / "1")).select("doc_id", "text").collect()
    texts = {r.doc_id: plain_print(r.text) for r in before}
    roots = smallest_reachable(set(texts.values()), near(sorted(set(texts.values()))))
    groups = collections.defaultdict(list)
    for i, p in texts.items():
        groups[roots[p]].append(i)
    assert sorted(r.doc_id for r in deduped.collect()) == sorted(map(min, groups.values()))
    mixed = collections.Counter(r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).collect())
    assert max(mixed.values()) <= 3
    whole = {(r.doc_id, r.piece, r.ids_crc32, r.length) for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert whole == {(r.doc_id, r.piece, r.ids_crc32, r.length) for r in docs.collect()}
    assert {r.doc_id for r in docs.collect()} == set(mixed)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, very long texts, columns that hide places; then an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(120).collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long, _metadata string, row_place int"
    rows = [(*(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), "m", 1) for r in given]
    long = " ".join(f"{r.text}" for r in given if r.lang == "en" and r.text)
    rows += rows[:7] + [(None, *rows[9][1:]), (None, *rows[9][1:]), (None, None, None, None, None, None, None)]
    rows += [(900, None, "en", "a", 0, "m", 1), (901, "", "en", "a", 0, "m", 1), (902, long * 3, "en", None, 0, "m", 1)]
    for name, table in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame(table, schema)
        docs.write.parquet(str(tmp_path / name / "in"))
        docs = spark.read.parquet(str(tmp_path / name / "in"))
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = collections.Counter((r.doc_id, r.text) for r in docs.collect())
            out = stage(spark, docs, SF_DIR)
            if number < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name / str(number)))
            docs = spark.read.parquet(str(tmp_path / name / str(number)))
            if number < 3:
                assert not collections.Counter((r.doc_id, r.text) for r in docs.collect()) - before
            if number == 2:
                prints = [plain_print(r.text) for r in docs.collect()]
                was = {plain_print(t) for _, t in before}
                roots = smallest_reachable(was, near(sorted(was)))
                assert sorted(roots[p] for p in prints) == sorted(set(roots.values()))
        assert (docs.count() > 50) == bool(table)


def test_shards_in_order(spark):
    df = spark.range(500).selectExpr("id", "CAST(id % 3 AS INT) AS shard", "xxhash64(id) AS place")
    for partitions in ("1", "4", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = [(r.shard, r.place) for r in mixing.in_shard_order(df, "shard", "place", 3).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == sorted(got) and len(got) == 500


def test_rows_of_files_are_known_by_their_place(spark, tmp_path):
    spark.range(50).selectExpr("id % 5 AS id").repartition(4).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for df, stored in ((common.with_row(table, "r", in_files=True), False), (common.with_row(table, "r"), True)):
        assert df.select("r").distinct().count() == 50
        first = sorted(map(str, df.collect()))
        assert first == sorted(map(str, df.where("id >= 0").collect()))
    clash = table.withColumn("_METADATA", F.lit(1))
    assert common.with_row(clash, "r", in_files=True).select("r").distinct().count() == 50
    made = spark.range(7).withColumn("x", F.lit(1))
    assert common.with_row(made, "r", in_files=True).select("r").distinct().count() == 7
