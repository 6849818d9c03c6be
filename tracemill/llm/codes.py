"""Compressing vectors to short codes of codebook entries, with adaptive bounds (operator 12).

A vector is cut into parts, and each part is replaced by the nearest entry of its codebook; entries move to the
means of their parts, and parts are assigned again. Between the rounds each part keeps its ``b`` closest entries, a lower
bound on the distance to each of them in ascending order, and one outer bound for all other entries, stored beside the vector.
When the entries have moved, bounds shrink by the way that they went. With the exact distance to the entry of before,
the part stops at the first bound beyond it: entries up to there are measured in whole numbers, entries behind it cannot
win. Only where even the outer bound does not hold are all entries measured, and a new list of the closest is
made. ``b`` shrinks to the depth at which nearly all parts stopped.

Bounds are 16-bit floats, always rounded down, which only makes them weaker; every decision between entries compares
whole numbers. Vectors are not shuffled. What comes together are sums per codebook entry and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import ship_package
from tracemill.storage import written

PARTS = 16
#: Entries of a codebook, and how many there may be: an index is one byte.
ENTRIES = 64
ENTRIES_MOST = 256
ROUNDS = 2
#: Components are whole numbers, so many to one.
SCALE = 256
#: Larger components are cut off here, so that squared distances fit a long.
MOST = 1 << 24
#: Entries that a part keeps bounds for at first.
CLOSEST = 8
CLOSEST_MOST = 254
#: The share of the parts which bounds settled that a smaller ``b`` must settle too.
SETTLED = 0.99
#: Rows whose distances to all entries are held at a time.
BLOCK_ROWS = 4096


def cuts(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; the first ones are longer by one if ``width`` does not divide."""
    ends = np.cumsum([width // parts + (i < width % parts) for i in range(parts)])
    return [(int(a), int(b)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances as whole numbers, of each row of ``x`` to each of its entries (rows of ``entries``, or one list
    for all)."""
    difference = x[:, None, :] - entries
    return np.einsum("nkw,nkw->nk", difference, difference)


def _down(x: np.ndarray) -> np.ndarray:
    """16-bit floats that are not above ``x`` (not negative)."""
    half = np.minimum(x, 65504.0).astype(np.float16)
    half = np.where(half.astype(np.float64) > x, np.nextafter(half, np.float16(0)), half)
    return np.where(np.isinf(x), np.float16(np.inf), half)


class Closest(NamedTuple):
    """What a part keeps: its closest entries, bounds on the distance to them in ascending order, the outer bound."""

    entries: np.ndarray  #: (rows, b) bytes; the first is the one that the part is assigned to
    bounds: np.ndarray  #: (rows, b) 16-bit floats
    outer: np.ndarray  #: (rows,) 16-bit floats; infinite where no entry is left out


def measured(x: np.ndarray, book: np.ndarray, b: int) -> tuple[Closest, np.ndarray]:
    """The closest entries of each row of ``x`` from all distances, and the squared distance to the first."""
    b = min(b, len(book))
    kept, least = [], []
    for at in range(0, len(x), BLOCK_ROWS):
        found = squares(x[at : at + BLOCK_ROWS], book)
        order = np.argsort(found, axis=1, kind="stable")[:, : b + 1]  # of equal distances the lower index first
        near = np.take_along_axis(found, order, axis=1)
        least.append(near[:, 0])
        roots = _down(np.sqrt(near.astype(np.float64)) * (1 - 1e-12))
        outer = roots[:, b] if len(book) > b else np.full(len(found), np.inf, np.float16)
        kept.append(Closest(order[:, :b].astype(np.uint8), roots[:, :b], outer))
    if not kept:
        empty = Closest(np.zeros((0, b), np.uint8), np.zeros((0, b), np.float16), np.zeros(0, np.float16))
        return empty, np.zeros(0, np.int64)
    return Closest(*map(np.concatenate, zip(*kept, strict=True))), np.concatenate(least)


def reassigned(
    x: np.ndarray, book: np.ndarray, moved: np.ndarray, kept: Closest, b: int
) -> tuple[Closest, np.ndarray, np.ndarray]:
    """(closest entries, squared distance to the first, depth) after the entries went the ways ``moved``.

    ``depth`` is how many kept entries were measured, one more than there are where all entries were. No more than
    ``b`` entries are kept.
    """
    had = kept.entries.shape[1]
    slack = 1e-9 * (kept.bounds.astype(np.float64) + 1)
    lower = kept.bounds.astype(np.float64) - moved[kept.entries] * (1 + 1e-9) - slack
    outer = kept.outer.astype(np.float64)
    outer = outer - moved.max(initial=0) * (1 + 1e-9) - np.where(np.isinf(outer), 0, 1e-9 * (outer + 1))
    # a bound holds for its entry and all behind it
    lower = np.minimum.accumulate(np.column_stack([lower, outer])[:, ::-1], axis=1)[:, ::-1]
    lower = np.maximum(lower, 0)
    first = squares(x, book[kept.entries[:, :1]])[:, 0]
    reach = np.sqrt(first.astype(np.float64)) * (1 + 1e-9)
    beyond = lower[:, 1:] > reach[:, None]
    depth = np.where(beyond.any(axis=1), beyond.argmax(axis=1) + 1, had + 1)

    entries, values, least = kept.entries.copy(), lower[:, :had].copy(), first.copy()
    values[:, 0] = np.sqrt(first.astype(np.float64)) * (1 - 1e-12)
    some = np.flatnonzero((depth > 1) & (depth <= had))
    for at in range(0, len(some), BLOCK_ROWS):
        rows = some[at : at + BLOCK_ROWS]
        near = kept.entries[rows]
        exact = squares(x[rows], book[near])
        look = np.arange(had) < depth[rows, None]
        value = np.where(look, np.sqrt(exact.astype(np.float64)) * (1 - 1e-12), lower[rows, :had])
        # the winner by whole numbers, then index, among those that were measured; the others follow by their bounds
        best = np.where(look, exact, np.iinfo(np.int64).max)
        least[rows] = best.min(axis=1)
        ties = np.where(best == least[rows, None], near.astype(np.int64), ENTRIES_MOST)
        winner = ties.argmin(axis=1)
        value[np.arange(len(rows)), winner] = -1
        order = np.argsort(value, axis=1, kind="stable")
        value[np.arange(len(rows)), winner] = np.sqrt(least[rows].astype(np.float64)) * (1 - 1e-12)
        entries[rows] = np.take_along_axis(near, order, axis=1)
        values[rows] = np.take_along_axis(value, order, axis=1)
    outer = np.maximum(outer, 0)
    b = min(b, had)
    if b < had:  # entries that are let go are others from now on
        outer = np.minimum(outer, values[:, b:].min(axis=1))
    found = Closest(entries[:, :b], _down(np.maximum(values[:, :b], 0)), _down(outer))
    unsure = np.flatnonzero(depth > had)
    if len(unsure):
        fresh, exact = measured(x[unsure], book, b)
        least[unsure] = exact
        for old, new in zip(found, fresh, strict=True):
            old[unsure] = new
    return found, least, depth


def fewer(b: int, depths: dict[int, int], share: float = SETTLED) -> int:
    """The smallest ``b`` that would have settled ``share`` of the parts that ``b`` settled."""
    settled = {depth: n for depth, n in depths.items() if depth <= b}
    total, seen = sum(settled.values()), 0
    for depth in sorted(settled):
        seen += settled[depth]
        if seen >= share * total:
            return depth
    return b


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(rows)], pa.binary())


def _unpacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _assigned(
    table: DataFrame, width: int, books: list[np.ndarray], moved: list[np.ndarray] | None, had: int, b: int
) -> DataFrame:
    """``table`` (``id``, ``label``, ``x``, and what the round before kept) with its entries under ``books``.

    ``code`` has the entries, ``errors`` the sum of squared distances, ``depth`` how far each part looked, and
    ``closest``, ``bounds``, ``outer`` what parts keep.
    """
    schema = T.StructType(
        [
            *(table.schema[c] for c in ("id", "label", "x")),
            *(T.StructField(c, T.BinaryType()) for c in ("code", "closest", "bounds", "outer", "depth")),
            T.StructField("error", T.LongType()),
        ]
    )
    spans = cuts(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _matrix(batch.column(2), width), batch.num_rows
            if moved is not None:
                entries = _unpacked(batch.column(3), np.uint8, PARTS, had)
                bounds = _unpacked(batch.column(4), np.float16, PARTS, had)
                outer = _unpacked(batch.column(5), np.float16, PARTS)
            found, error, depths = [], np.zeros(n, np.int64), []
            for part, (start, stop) in enumerate(spans):
                own, book = x[:, start:stop], books[part]
                if moved is None:
                    kept, least = measured(own, book, b)
                    depth = np.zeros(n, np.uint8)
                else:
                    before = Closest(entries[:, part], bounds[:, part], outer[:, part])
                    kept, least, depth = reassigned(own, book, moved[part], before, b)
                found.append(kept)
                error += least
                depths.append(depth.astype(np.uint8))
            entries, bounds, outer = (np.stack(field, axis=1) for field in zip(*found, strict=True))
            packed = [entries[:, :, 0], entries.reshape(n, -1), bounds.reshape(n, -1), outer, np.stack(depths, axis=1)]
            columns = [*batch.columns[:3], *map(_binary, packed), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    kept = [] if moved is None else ["closest", "bounds", "outer"]
    return table.select("id", "label", "x", *kept).mapInArrow(run, schema)


def _sums(table: DataFrame, width: int, entries: int) -> DataFrame:
    """(``part``, ``entry``, ``place``, ``total``): sums per component of the parts of each entry, their number at
    place -1, and under part -1 how many parts looked how deep."""
    spans = cuts(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((entries, width), np.int64)
        counts, depths = np.zeros((PARTS, entries), np.int64), np.zeros(entries + 2, np.int64)
        for batch in batches:
            x, code = _matrix(batch.column(0), width), _unpacked(batch.column(1), np.uint8, PARTS)
            for part, (start, stop) in enumerate(spans):
                counts[part] += np.bincount(code[:, part], minlength=entries)
                for place in range(start, stop):  # exact: a batch's sums are far below 2 ** 53
                    own = np.bincount(code[:, part], x[:, place].astype(np.float64), entries)
                    sums[:, place] += own.astype(np.int64)
            looked = _unpacked(batch.column(2), np.uint8, PARTS)
            depths += np.bincount(looked.ravel(), minlength=entries + 2)
        rows = [(-1, depth, -1, n) for depth, n in enumerate(depths.tolist()) if n]
        for part, (start, stop) in enumerate(spans):
            for entry in np.flatnonzero(counts[part]).tolist():
                rows.append((part, entry, -1, int(counts[part, entry])))
                rows += [(part, entry, i, s) for i, s in enumerate(sums[entry, start:stop].tolist())]
        if rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "total"])

    partial = table.select("x", "code", "depth").mapInArrow(run, "part long, entry long, place long, total long")
    return partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def _next(books: list[np.ndarray], totals: dict[tuple[int, int, int], int]) -> list[np.ndarray]:
    """Every used entry at the mean of its parts, rounded down."""
    found = [book.copy() for book in books]
    for (part, entry, place), total in totals.items():
        if part >= 0 and place >= 0:
            found[part][entry, place] = total // totals[part, entry, -1]
    return found


def _ways(old: list[np.ndarray], new: list[np.ndarray]) -> list[np.ndarray]:
    """How far each entry went."""
    return [np.sqrt(((a - b) ** 2).sum(axis=1).astype(np.float64)) for a, b in zip(old, new, strict=True)]


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry, and place, separated by commas."""
    return hashlib.sha256(",".join(str(int(c)) for book in books for c in book.ravel()).encode()).hexdigest()


def _whole(vector: Column) -> Column:
    def scaled(x: Column) -> Column:
        return F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int")

    return F.transform(vector, scaled)


def codes(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    entries: int = ENTRIES, rounds: int = ROUNDS, closest: int = CLOSEST,
) -> DataFrame:
    """(id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``) of every vector that is kept.

    Vectors that are null or hold null or non-finite components go. Codebooks start with the parts of the ``entries``
    (256 at most) smallest ids. ``code`` has two hexadecimal digits per part, ``error`` the squared distances of
    all parts in whole numbers, ``label_error`` their sum over all vectors of the label (null is one label).

    The driver holds the codebooks: ``entries`` numbers per component, whatever the number of vectors.

    Edge cases: ids that are null count as the largest; of rows that share an id the smaller vector comes first, each
    row a vector of its own. With fewer vectors than ``entries``, all of them are entries. Components beyond 65,536 are
    cut off there. The first vector says how long vectors are: others are returned with null code and error, and teach
    nothing. Lengths that 16 does not divide make the first parts longer by one component; vectors without components have
    code 0 and error 0. An empty table, or one where no vector is kept, gives no rows. Other columns are ignored.
    """
    ship_package(table.sparkSession)
    vector = F.col("v")
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    picked = table.select(table[id_col].alias("id"), table[label_col].alias("label"), table[vector_col].alias("v"))
    vectors = written(picked.where(vector.isNotNull() & finite).select("id", "label", _whole(vector).alias("x")), "vectors")
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "x").select(F.size("x").alias("n")).limit(1).collect()
    width = first[0]["n"] if first else 0
    fit = vectors.where(F.size("x") == width)
    seeds = fit.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    start = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), width)
    books = [start[:, a:b].copy() for a, b in cuts(width)]

    state, moved, had, b = fit, None, 0, max(1, min(closest, len(seeds), CLOSEST_MOST))
    for _ in range(rounds if seeds else 0):
        state = written(_assigned(state, width, books, moved, had, b), "parts")
        had = b
        found = _sums(state, width, len(seeds)).collect()  # at most a number per component and entry
        totals = {(r["part"], r["entry"], r["place"]): r["total"] for r in found}
        if moved is not None:
            b = fewer(b, {depth: n for (part, depth, _), n in totals.items() if part < 0})
        new = _next(books, totals)
        books, moved = new, _ways(books, new)
    coded = _assigned(state, width, books, moved, had, b).select(
        "id", "label", F.lower(F.hex("code")).alias("code"), "error"
    )
    others = vectors.where(F.size("x") != width).select(
        "id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    coded = written(coded.unionByName(others), "codes")
    sums = coded.groupBy(F.col("label").alias("named")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("named"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _codes_sql() -> str:
    """All distances of all rounds, without bounds."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"""near{r} AS (SELECT n, p, min({{d: list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
        e: e}}) AS m FROM parts JOIN book{r} USING (p) GROUP BY n, p)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""means{r} AS (SELECT p, e, list(c ORDER BY i) AS c FROM (SELECT parts.p, m.e AS e, i,
        floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS c FROM parts JOIN near{r} USING (n, p),
        unnest(range(1, len(x) + 1)) AS u(i) GROUP BY parts.p, m.e, i) GROUP BY p, e),
    book{r + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e)"""
            )
    chain = ",\n    ".join(steps)
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v,
        row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS n FROM embeddings WHERE embedding IS NOT NULL
        AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
    parts AS (SELECT n, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
        FROM kept, range({PARTS}) AS t(p)),
    book0 AS (SELECT p, n AS e, x AS c FROM parts WHERE n < {ENTRIES}),
    {chain},
    digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
        SELECT p, e, i, b.c[i] AS c FROM book{ROUNDS} b, unnest(range(1, len(b.c) + 1)) AS u(i))),
    coded AS (SELECT n, string_agg(lower(printf('%02X', m.e::INT)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error
        FROM near{ROUNDS} GROUP BY n)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), digest"""


CODES_SQL = _codes_sql()
