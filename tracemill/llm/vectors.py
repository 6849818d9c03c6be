"""Near-duplicate embeddings by sorted projection passes (operator 7).

Each pass gives a vector 64 random hyperplane bits and orders all vectors by them; in that order
every vector is compared with the next few. Vectors at a small angle share long prefixes of bits and
meet in some pass. Pairs at the threshold are united across passes into components. Passes find which
vectors belong together; inside a component the links of every vector are then counted exactly, so a
window's bound loses none of them.

Equal vectors are one before the passes, so copies take no place in a window. The number of passes follows
the number of distinct vectors and the recall that is asked for, and more are made while they still join
components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import ship_package
from tracemill.llm.components import components
from tracemill.llm.prefix import running_totals
from tracemill.storage import Collected, written

THRESHOLD = 0.9
#: Fewest passes; tables of more than some fifteen thousand distinct vectors take more.
PASSES = 20
#: Share of isolated pairs at the threshold that the passes are planned to find.
RECALL = 0.99
WINDOW = 16
#: Passes that are dealt out in one shuffle; it moves so many copies of the vectors at a time.
PASSES_AT_ONCE = 5
#: Vectors per block when the links of a component are counted.
BLOCK = 1024
SEED = 11
#: Slack for rounding when angles decide without a comparison.
_SLACK = 1e-9


def _units(values: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, from the bytes of vectors of one length."""
    x = np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _kind(vectors: DataFrame, vector_col: str) -> str:
    """How components are stored: as wide as they came."""
    element = vectors.schema[vector_col].dataType.elementType
    return "<f4" if isinstance(element, T.FloatType) else "<f8"


def _chance(distinct: int, window: int, threshold: float) -> float:
    """Estimate of how likely one pass brings an isolated pair at the threshold into a window.

    Two vectors agree in a hyperplane bit with probability 1 - angle / pi, and meet when they agree in as many
    first bits as leave ``window`` of ``distinct`` vectors.
    """
    agree = 1 - float(np.arccos(threshold)) / np.pi
    return agree ** max(0.0, float(np.log2(max(distinct, 1) / window)))


def planned_passes(
    distinct: int, recall: float = RECALL, window: int = WINDOW, threshold: float = THRESHOLD, least: int = PASSES
) -> int:
    """Passes, at least ``least``, that find a share ``recall`` of isolated pairs at the threshold."""
    chance = _chance(distinct, window, threshold)
    return least if chance >= 1 else max(least, int(np.ceil(np.log1p(-recall) / np.log1p(-chance))))


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``row``, ``id``, ``dim``, ``unit`` as bytes); dim and unit are null for a vector that is null, empty,
    zero, or has null or non-finite components.

    Components of floats are stored as they came; doubles are divided by the largest first, so that no
    square over- or underflows. Whoever reads them scales them to length one."""
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", vectors.schema[id_col].dataType),
            T.StructField("dim", T.IntegerType()),
            T.StructField("unit", T.BinaryType()),
        ]
    )
    ship_package(vectors.sparkSession)
    kind = _kind(vectors, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, dims = [], []
            for values in batch.column(2).to_pylist():
                stored = None
                if values and None not in values:
                    x = np.array(values, np.float64)
                    size = np.abs(x).max()
                    if np.isfinite(size) and size > 0:
                        stored = (x if kind == "<f4" else x / size).astype(kind).tobytes()
                units.append(stored), dims.append(None if stored is None else len(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                names=schema.names,
            )

    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), vectors[id_col].alias("id"), vectors[vector_col].alias("v")
    )
    return rows.mapInArrow(run, schema)


#: Rows that are multiplied at a time.
PRODUCT_ROWS = 1024


def _by_dim(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each dimension, so many at a time."""
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        for at in range(0, len(rows), PRODUCT_ROWS):
            yield dim, rows[at : at + PRODUCT_ROWS]


def pass_keys(units: DataFrame, kind: str, passes: range, seed: int) -> DataFrame:
    """(``row``, ``dim``, ``unit``, ``keys``): the 64 hyperplane bits of each of ``passes``."""
    n = len(passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, units_ = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            keys = np.zeros((batch.num_rows, n), np.int64)
            for dim, rows in _by_dim(dims):
                if dim not in planes:
                    draws = [np.random.default_rng([seed, dim, p]).standard_normal((64, dim)) for p in passes]
                    planes[dim] = np.concatenate(draws)
                signs = _units([units_[i] for i in rows], kind) @ planes[dim].T > 0
                packed = np.packbits(signs.reshape(len(rows), n, 64), axis=2)  # the first plane is the highest bit
                keys[rows] = packed.view(">u8")[..., 0].astype(np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, n, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["row", "dim", "unit", "keys"])

    return units.select("row", "dim", "unit").mapInArrow(run, "row long, dim int, unit binary, keys array<long>")


class _Forest:
    """Union-find over the rows of one task; tells which pairs join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (parent := self.up.get(x, x)) != x:
            path.append(x)
            x = parent
        for y in path:
            self.up[y] = x
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[a] = b
        return a != b


def window_pairs(
    units: DataFrame, kind: str, passes: range, window: int, threshold: float, seed: int
) -> DataFrame:
    """(``a``, ``b``): rows at or above the threshold that meet in a window of ``passes``, as a forest.

    The passes are dealt out by ranges in one shuffle. Of the verified pairs of a task only those that
    join two of its trees are returned, which are fewer than its rows.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        before = np.zeros((0, 2), np.int64)  # pass and dimension of the rows carried on
        rows, matrix = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new_rows = batch.column(0).to_numpy()
            new_kinds = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            units_ = batch.column(3).to_pylist()
            starts = np.flatnonzero(np.any(new_kinds[1:] != new_kinds[:-1], axis=1)) + 1
            found: list[tuple[int, int]] = []
            for part in np.split(np.arange(len(new_rows)), starts):
                block = _units(units_[part[0] : part[-1] + 1], kind)
                now = new_kinds[part[0]]
                follows = matrix is not None and (before[-1] == now).all()
                z = np.concatenate([matrix, block]) if follows else block
                r = np.concatenate([rows, new_rows[part]]) if follows else new_rows[part]
                old = len(r) - len(part)
                for gap in range(1, min(window, len(r) - 1) + 1):
                    first = max(0, old - gap)
                    close = np.einsum("ij,ij->i", z[first + gap :], z[first : len(z) - gap]) >= threshold
                    for i in np.flatnonzero(close).tolist():
                        a, b = int(r[first + i]), int(r[first + i + gap])
                        if forest.joins(a, b):
                            found.append((a, b))
                rows, matrix, before = r[-window:].copy(), z[-window:].copy(), np.array([now])
            if found:
                ends = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    each = pass_keys(units, kind, passes, seed).select(
        "row",
        F.posexplode("keys").alias("pass", "key"),
        F.col("dim").cast("long").alias("dim"),
        "unit",
    )
    order = ["dim", "pass", "key", "row"]
    dealt = each.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("row", F.col("pass").cast("long"), "dim", "unit").mapInArrow(run, schema)


def _angles(members: DataFrame, kind: str) -> DataFrame:
    """(``root``, ``row``, ``angle``): from each member to the mean direction of its component."""
    sums = T.StructType(
        [T.StructField("root", T.LongType()), T.StructField("sum", T.ArrayType(T.DoubleType()))]
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            roots, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            units = batch.column(1).to_pylist()
            lists = [np.zeros(0)] * len(roots)
            dims = np.array([len(unit) for unit in units])  # one for all members of a root
            for _, rows in _by_dim(dims):
                x, own = _units([units[i] for i in rows], kind), at[rows]
                order = np.argsort(own, kind="stable")
                firsts = np.flatnonzero(np.diff(own[order], prepend=-1))
                for i, total in zip(own[order][firsts].tolist(), np.add.reduceat(x[order], firsts), strict=True):
                    lists[i] = lists[i] + total if len(lists[i]) else total
            yield pa.RecordBatch.from_arrays(
                [pa.array(roots), pa.array([x.tolist() for x in lists], pa.list_(pa.float64()))], names=["root", "sum"]
            )

    parts = members.select("root", "unit").mapInArrow(partial, sums)
    axis = parts.select("root", F.posexplode("sum").alias("i", "x")).groupBy("root", "i").agg(F.sum("x").alias("x"))
    centres = axis.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("centre"))

    @F.arrow_udf(T.DoubleType())
    def angle(units: pa.Array, directions: pa.Array) -> pa.Array:
        out = np.zeros(len(units))
        flat, starts = directions.flatten().to_numpy(zero_copy_only=False), np.diff(directions.offsets.to_numpy())
        ends = np.cumsum(starts)
        units_ = units.to_pylist()
        for dim, rows in _by_dim(starts):
            c = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
            size = np.sqrt(np.einsum("ij,ij->i", c, c))[:, None]
            # the angle of two unit vectors from their difference and sum keeps all digits
            x, y = _units([units_[i] for i in rows], kind), c / np.where(size > 0, size, 1)
            found = 2 * np.arctan2(np.linalg.norm(x - y, axis=1), np.linalg.norm(x + y, axis=1))
            out[rows] = np.where(size[:, 0] > 0, found, np.pi)
        return pa.array(out, pa.float64())

    # Stored, so that Spark knows how few there are, and the join below may split a large component.
    joined = members.join(written(centres, "centres"), "root")
    return joined.select("root", "row", angle("unit", "centre").alias("angle"))


def _counted(members: DataFrame, kind: str, threshold: float, block: int) -> DataFrame:
    """(``row``, ``n_links``): links of each member inside its component, counted block against block.

    A component is cut into blocks; each pair of blocks is one group of at most two blocks of vectors.
    """
    ranked = running_totals(members, ["row"], {"rank": F.lit(1)}, ["root"])
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    blocks = F.expr(f"(size + {block - 1}) DIV {block}")
    own = ranked.join(sizes, "root").withColumn("own", F.expr(f"rank DIV {block}")).withColumn("blocks", blocks)
    met = own.select(
        "root", "row", "unit", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    ).select(
        "root", "row", "unit", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )

    def count(group: pd.DataFrame) -> pd.DataFrame:
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        matrix = _units(list(group["unit"]), kind)
        own_block = group["own"].to_numpy()
        left, right = matrix[own_block == low], matrix[own_block == high]
        close = left @ right.T >= threshold
        rows_left = group["row"].to_numpy()[own_block == low]
        if low == high:
            np.fill_diagonal(close, False)
            return pd.DataFrame({"row": rows_left, "n": close.sum(axis=1)})
        rows_right = group["row"].to_numpy()[own_block == high]
        return pd.DataFrame(
            {"row": np.concatenate([rows_left, rows_right]), "n": np.concatenate([close.sum(axis=1), close.sum(axis=0)])}
        )

    counts = met.groupBy("root", "low", "high").applyInPandas(count, "row long, n long")
    return counts.groupBy("row").agg(F.sum("n").alias("n_links"))


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
    passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, seed: int = SEED, recall: float = RECALL,
) -> DataFrame:
    """(id, ``n_links``, ``component_id``, ``kept``) of every vector.

    Links join vectors with a cosine, in double precision, of ``threshold`` or more. ``n_links`` counts
    all of a vector's links inside its component. Where all members lie so close to the mean direction
    that any two must be linked (angles to it sum up to an upper bound of the angle between), they are
    counted without comparing; other components are compared block against block.

    ``passes`` are the fewest; :func:`planned_passes` says how many a table takes for ``recall``. After them
    :data:`PASSES_AT_ONCE` more are made, and again while what they newly join shows that more than a share
    ``1 - recall`` of all joins is missing. A pair can be missed only if it meets in no pass and no chain of
    found pairs connects it; see the README for the measured recall.

    Edge cases: vectors that are null, empty, zero, or hold null or non-finite components have no links
    and are their own component. Vectors of different lengths are never linked. Repeated rows are
    vectors of their own; rows that share the smallest id of a component are all kept. A null id is never
    the smallest, and such a row is kept only if its component has no id. An empty table gives no rows.
    """
    kind = _kind(vectors, vector_col)
    units = written(usable_vectors(vectors, id_col, vector_col), "units")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    found = Collected(vectors.sparkSession, schema, "pairs")
    usable = units.where("unit IS NOT NULL")
    same = usable.select("row", F.sha2("unit", 256).alias("same"))  # 64 digits instead of a vector
    firsts = written(same.groupBy("same").agg(F.min("row").alias("b")), "firsts")
    found.add(same.join(firsts, "same").where("row <> b").select(F.col("row").alias("a"), "b"))
    first_rows = firsts.select(F.col("b").alias("row"))
    distinct = written(usable.join(first_rows, "row", "left_semi").select("row", "dim", "unit"), "distinct")

    n = firsts.count()
    planned = planned_passes(n, recall, window, threshold, passes)
    for first in range(0, planned, PASSES_AT_ONCE):
        some = range(first, min(planned, first + PASSES_AT_ONCE))
        found.add(window_pairs(distinct, kind, some, window, threshold, seed))
    joined = components(found.table())
    chance = 1 - (1 - _chance(n, window, threshold)) ** PASSES_AT_ONCE
    while True:
        some = range(planned, planned + PASSES_AT_ONCE)
        planned = some.stop
        met = window_pairs(distinct, kind, some, window, threshold, seed)
        for end in ("a", "b"):
            root = joined.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            met = met.join(root, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        new = found.add(met.where("root_a <> root_b").select("a", "b")).count()
        if new == 0:
            break
        joined = components(found.table())
        joins = joined.where("node <> root").count()
        if new * (1 - chance) <= (1 - recall) * joins * chance:
            break
    joined = joined.withColumnRenamed("node", "row")
    members = written(units.join(joined, "row").select("root", "row", "id", "unit"), "members")
    # Stored before it is summed, so that a component with many of the vectors may be split in the join.
    angles = written(_angles(members, kind), "angles")
    spread = angles.groupBy("root").agg(F.max("angle").alias("spread"), F.count("*").alias("size"))
    first = members.groupBy("root").agg(F.min("id").alias("first"))
    tight = F.col("spread") * 2 + _SLACK <= float(np.arccos(threshold))
    stats = written(spread.join(first, "root").withColumn("tight", tight), "groups")

    loose = members.join(stats.where("NOT tight").select("root"), "root", "left_semi").select("root", "row", "unit")
    counted = _counted(loose, kind, threshold, block)
    known = members.select("root", "row").join(stats, "root").join(counted, "row", "left")
    known = known.select(
        "row", F.when(F.col("tight"), F.col("size") - 1).otherwise(F.col("n_links")).alias("n"), "root", "first"
    )
    result = units.select("row", "id").join(known, "row", "left")
    component = F.when(F.col("root").isNotNull(), F.col("first")).otherwise(F.col("id"))
    return result.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
