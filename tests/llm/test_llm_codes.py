"""Vector codes against all distances, and the bounds on their own."""

import hashlib
import math
import random

import numpy as np
import pytest

from tracemill.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, x int, ID2 string"


def plain_codes(rows, entries=codes.ENTRIES):
    """Everything by all distances, in Python numbers."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    whole = [(i, [max(-codes.MOST, min(codes.MOST, math.floor(256 * c))) for c in v], label) for i, v, label in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not whole:
        return []
    width = len(whole[0][1])
    fit = [r for r in whole if len(r[1]) == width]
    spans = codes.cuts(width)
    books = [[v[a:b] for _, v, _ in fit[:entries]] for a, b in spans]

    def nearest(v):
        found = []
        for (a, b), book in zip(spans, books, strict=True):
            found.append(min((sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)), k) for k, e in enumerate(book)))
        return found

    for _ in range(2):
        picked = [nearest(v) for _, v, _ in fit]
        for part, (a, b) in enumerate(spans):
            for k in range(len(books[part])):
                own = [v[a:b] for (_, v, _), p in zip(fit, picked, strict=True) if p[part][1] == k]
                if own:
                    books[part][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in whole:
        found = nearest(v) if len(v) == width else None
        error = sum(d for d, _ in found) if found else None
        code = "".join(f"{k:02x}" for _, k in found) if found else None
        sums.setdefault(label, [])
        if error is not None:
            sums[label].append(error)
        out.append((i, code, error, label))
    return sorted(
        ((i, code, error, sum(sums[label]) if sums[label] else None, digest) for i, code, error, label in out), key=str
    )


def vectors(n, width=32, seed=1, spread=0.3, centres=20):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (centres, width))
    rows = []
    for i in range(n):
        v = middle[rng.integers(centres)] + rng.normal(0, spread, width)
        rows.append((i, [float(np.float32(c)) for c in v], [None, 0, 1, 2][rng.integers(4)]))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "d") for r in rows], SCHEMA).repartition(3)


def found(spark, rows, **options):
    return sorted(map(tuple, codes.codes(table(spark, rows), **options).collect()), key=str)


@pytest.mark.parametrize(
    ("n", "options"), [(400, {}), (400, {"closest": 1}), (400, {"closest": 64}), (400, {"entries": 7, "closest": 3}), (40, {})]
)
def test_codes_are_those_of_all_distances(spark, n, options):
    rows = vectors(n)
    assert found(spark, rows, **options) == plain_codes(rows, options.get("entries", codes.ENTRIES))


def test_codes_of_odd_rows(spark):
    """Nulls, infinities, ties and repeated rows, null and repeated ids, large components, other lengths."""
    rnd = random.Random(2)
    rows = vectors(120, width=19, seed=3)
    rows += [(i, [rnd.choice([0.0, 0.25, -0.0625]) for _ in range(19)], 5) for i in range(120, 200)]
    rows += [rows[150]] * 30 + [rows[0]] * 3
    rows += [(500, None, 1), (501, [None] * 19, 1), (502, [math.nan] + [0.0] * 18, 1), (503, [math.inf] * 19, 9)]
    rows += [(None, [0.5] * 19, None), (None, [0.25] * 19, None), (5, [1.0] * 19, 2), (600, [3e38, -3e38] + [1.0] * 17, 2)]
    rows += [(700, [0.5] * 4, 2), (701, [], 77)]
    assert found(spark, rows) == plain_codes(rows)


def test_codes_of_short_and_no_vectors(spark):
    rows = [(i, [0.01 * i] * 3, None) for i in range(90)]  # fewer components than parts
    assert found(spark, rows) == plain_codes(rows)
    empty = [(i, [], 1) for i in range(3)]
    assert [r[:3] for r in found(spark, empty)] == [(i, "00" * 16, 0) for i in range(3)]
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []


def test_bounds_hold_and_shrink():
    """What a part keeps stays true over many moves: ascending bounds, none above the distance that it bounds."""
    rng = np.random.default_rng(4)
    x = rng.integers(-150, 150, (500, 4))
    book = rng.integers(-150, 150, (64, 4))
    kept, least = codes.measured(x, book, 8)
    looked = []
    for step in range(6):
        new = book + rng.integers(-(12 >> step), (12 >> step) + 1, book.shape)
        b = 8 if step < 3 else 4
        kept, least, depth = codes.reassigned(x, new, codes._ways([book], [new])[0], kept, b)
        book = new
        exact = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (least == exact.min(axis=1)).all() and (kept.entries[:, 0] == exact.argmin(axis=1)).all()
        roots = np.sqrt(exact)
        bounds = kept.bounds.astype(float)
        assert (bounds <= np.take_along_axis(roots, kept.entries.astype(int), axis=1)).all()
        assert (np.diff(bounds, axis=1) >= 0).all()
        others = roots.copy()
        np.put_along_axis(others, kept.entries.astype(int), np.inf, axis=1)
        assert (kept.outer.astype(float) <= others.min(axis=1)).all()
        looked.append(depth.mean())
    assert looked[-1] < looked[0]  # the less entries move, the less is measured


def test_half_floats_are_rounded_down():
    x = np.concatenate([np.random.default_rng(0).uniform(0, 1e5, 1000), [0, 65504, 1e9, np.inf]])
    half = codes._down(x)
    assert (half.astype(float) <= x).all() and np.isinf(half[-1]) and half[-2] == 65504


def test_fewer_follows_the_depths():
    assert codes.fewer(8, {1: 990, 2: 9, 8: 1, 9: 5000}) == 1
    assert codes.fewer(8, {1: 900, 3: 95, 8: 5}) == 3
    assert codes.fewer(8, {9: 10}) == 8
