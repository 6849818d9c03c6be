"""Merkle manifest of a dataset, as a persistent tree (operator 11).

Rows are leaves, in the order of their ids within a group; two neighbours become one node until one is left,
the *subroot* of the group, and the subroots become the *root* in the same way. Trees are cut into aligned
blocks of 1,024 nodes: a task builds the ten levels above a block, and the nodes that are left form the blocks
of the next round. Rounds grow with the logarithm of the rows to the base 1,024.

A tampered leaf makes a *version* of the tree. Nothing is overwritten: the version copies the ancestors of its leaf,
first those within the leaf's block, in the task that holds the block, then those above; every other node is
the one that all versions share. What a version needs from above is one sibling per level, the same for all leaves of a
block, so it is found once per block on the way down and joined to the block: versions go on in as many tasks as there are
blocks, and no task gathers the versions of an upper block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ship_package
from tracemill.llm.prefix import running_totals
from tracemill.storage import written

#: Levels of a block; it has 2 ** BLOCK_LEVELS nodes at most.
BLOCK_LEVELS = 10
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of ``fields`` as text: ``-`` for a null, else the number of bytes, a colon, and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _parent(left: bytes, right: bytes | None) -> bytes:
    """Digests are joined as hexadecimal text; a node without a neighbour is hashed alone."""
    return hashlib.sha256((left.hex() + (right.hex() if right is not None else "")).encode()).digest()


class Block:
    """The nodes above a block of ``leaves``, level by level; shared by all versions, never changed.

    The first block of a group ends at the group's last node; any other goes up all levels, as the group has more.
    """

    def __init__(self, leaves: list[bytes], number: int, block_levels: int):
        self.levels = [leaves]
        for _ in range(block_levels if number else (len(leaves) - 1).bit_length()):
            below = self.levels[-1]
            pairs = zip(below[::2], [*below[1::2], None] if len(below) & 1 else below[1::2], strict=True)
            self.levels.append([_parent(*pair) for pair in pairs])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def steps(self, place: int) -> list[bytes]:
        """What a leaf meets on its way up: per level nothing, or the sibling after a 0 (left) or 1 (right)."""
        found = []
        for nodes in self.levels[:-1]:
            sibling = place ^ 1
            found.append((b"\1" if sibling > place else b"\0") + nodes[sibling] if sibling < len(nodes) else b"")
            place >>= 1
        return found


def copied(leaf: bytes, steps: list[bytes]) -> list[bytes]:
    """The nodes that a version copies when it starts from ``leaf``: the leaf's ancestors, upwards."""
    nodes = []
    for step in steps:
        side, sibling = step[:1], step[1:]
        leaf = _parent(sibling, leaf) if side == b"\0" else _parent(leaf, sibling or None)
        nodes.append(leaf)
    return nodes


def proof_digest(steps: list[bytes]) -> str:
    """SHA-256 of the siblings' hexadecimal text, upwards."""
    return hashlib.sha256("".join(step[1:].hex() for step in steps).encode()).hexdigest()


def _blocks(nodes: DataFrame, block_levels: int, *more: str) -> DataFrame:
    """(``g``, ``block``, ``nodes``, ``more``): the nodes of each block in order, as arrays of bounded length."""
    row = F.struct("place", "node", *more)
    block = F.shiftright("place", block_levels).alias("block")
    grouped = nodes.groupBy("g", block).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return grouped.select("g", "block", *(F.col(f"rows.{c}").alias(c) for c in ("node", *more)))


def _tops(blocks: DataFrame, block_levels: int) -> DataFrame:
    """(``g``, ``place``, ``node``): the last node of every block, a node of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1), batch.column(2), strict=True)  # one block at a time
            tops = [Block(nodes.as_py(), number.as_py(), block_levels).top for number, nodes in rows]
            columns = [batch.column(0), batch.column(1), pa.array(tops, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "place", "node"])

    return blocks.select("g", "block", "node").mapInArrow(run, "g string, place long, node binary")


def _rounds(blocks: DataFrame, block_levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round from stored ``blocks`` on, and the last node of each group."""
    rounds = [blocks]
    while True:
        nodes = written(_tops(rounds[-1], block_levels), "nodes")
        if nodes.where("place > 0").isEmpty():
            return rounds, nodes
        rounds.append(written(_blocks(nodes, block_levels), "blocks"))


def _paths(blocks: DataFrame, above: DataFrame, block_levels: int) -> DataFrame:
    """(``g``, ``place``, ``steps``, ``ends``) of every node of ``blocks``: its steps to the root.

    ``above`` has the same of the last node of every block; ``ends`` has the subroot, if any, and the root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g, number, nodes, steps, ends = (column[row].as_py() for column in batch.columns)
                block, first = Block(nodes, number, block_levels), number << block_levels
                places = range(len(nodes))
                columns = [
                    pa.array([g] * len(places), pa.string()),
                    pa.array([first + i for i in places], pa.int64()),
                    pa.array([block.steps(i) + steps for i in places], pa.list_(pa.binary())),
                    pa.array([ends] * len(places), pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "place", "steps", "ends"])

    met = blocks.join(above.withColumnRenamed("place", "block"), ["g", "block"])
    met = met.select("g", "block", "node", "steps", "ends")
    return met.mapInArrow(run, "g string, place long, steps array<binary>, ends array<binary>")


def manifest(
    docs: DataFrame, altered: dict[str, Column] | None = None, where: Column | None = None,
    id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """(id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``, ``copied``) of every row.

    ``altered`` and ``where`` say which rows are tampered with and what their columns then hold. ``folded_root`` is the root
    of the row's version: recomputed from the tampered leaf, else the original one, and the original siblings; ``verified``
    tells whether it is the root. ``copied`` has the nodes that the version of a changed leaf holds of its own, from the
    leaf upwards to its root (null where no leaf changed). Digests are lowercase hexadecimal text; ``copied`` holds bytes.

    Texts are read once and not shuffled: from then on only digests and ids move. ``block_levels`` must be at least 1.

    Edge cases: a null in a field has a sign of its own; a null group comes before all others, null ids before all others of
    their group. Rows of one id are ordered by leaf, so equal rows are interchangeable leaves of their own. A group
    of one row is its own subroot, and a single subroot is the root; the proof of a lone leaf is the hash of nothing. A change that
    leaves a row as it was makes no version. An empty table gives no rows. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    new = {name: F.col(name) for name in fields} | (altered or {})
    changed = leaf_digest([new[name] for name in fields])
    group = F.col(group_col).cast("string")
    leaves = written(
        docs.select(
            F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"),  # a null sorts first and joins
            F.col(id_col).alias("id"),
            leaf_digest([F.col(name) for name in fields]).alias("node"),
            (F.when(where, changed) if where is not None else F.lit(None).cast("binary")).alias("changed"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    placed = running_totals(leaves, ["id", "node", "row"], {"place": F.lit(1)}, ["g"])
    ground, subroots = _rounds(
        written(_blocks(placed, block_levels, "id", "changed"), "blocks"), block_levels
    )
    places = running_totals(subroots.select("g", "node"), ["g"], {"place": F.lit(1)})
    places = written(places.withColumnRenamed("g", "name").withColumn("g", F.lit("")), "subroots")
    upper, root = _rounds(written(_blocks(places, block_levels), "blocks"), block_levels)

    # down again: the steps from each node to the root, down to the last nodes of the leaves' blocks
    paths = root.select("g", "place", F.array().cast("array<binary>").alias("steps"), F.array("node").alias("ends"))
    for blocks in reversed(upper):
        paths = written(_paths(blocks, paths, block_levels), "paths")
    ends = F.concat(F.array("node"), F.col("ends"))
    paths = paths.drop("g").join(places.drop("g"), "place").select(
        F.col("name").alias("g"), F.lit(0).cast("long").alias("place"), "steps", ends.alias("ends")
    )
    for blocks in reversed(ground[1:]):
        paths = written(_paths(blocks, paths, block_levels), "paths")

    met = ground[0].join(paths.withColumnRenamed("place", "block"), ["g", "block"])
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean, copied array<binary>"
    )
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copied"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, nodes, new, above, (subroot, root) = (batch.column(c)[row].as_py() for c in range(5))
                ids = batch.column(5)[row].values
                block = Block(nodes, number, block_levels)
                proofs, folds, copies = [], [], []
                for place, leaf in enumerate(nodes):
                    steps = block.steps(place) + above
                    proofs.append(proof_digest(steps))
                    start = new[place] if new[place] is not None else leaf
                    version = [start, *copied(start, steps)]
                    folds.append(version[-1])
                    copies.append(version if start != leaf else None)
                n = len(nodes)
                columns = [
                    ids,
                    pa.array([leaf.hex() for leaf in nodes]),
                    pa.array([subroot.hex()] * n),
                    pa.array([root.hex()] * n),
                    pa.array(proofs),
                    pa.array([fold.hex() for fold in folds]),
                    pa.array([fold == root for fold in folds]),
                    pa.array(copies, pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = met.select("block", "node", "changed", "steps", "ends", "id").mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_col)


def tampered_manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest of ``documents`` where every seventh id, by checksum, has a character more than it says."""
    name = F.col("doc_id").cast("string")
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    found = manifest(docs, {"n_chars": more}, F.crc32(name) % 7 == 0, block_levels=block_levels)
    return found.drop("copied")


#: The same tree, proofs and folds in SQL, one level a step; the checksum's table comes from its polynomial.
MANIFEST_SQL = """
WITH RECURSIVE powers AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
    fields AS (SELECT doc_id, lang, coalesce(lang, '') AS name, lang IS NOT NULL AS named,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        n_chars::HUGEINT AS n, coalesce(strlen(text) || ':' || text, '-') AS tail,
        list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT) AS b
        FROM documents),
    crcs AS (SELECT *, xor(4294967295, list_reduce(b, lambda c, x:
        xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS crc FROM fields, powers),
    hashed AS (SELECT doc_id, name, named, coalesce(crc % 7 = 0, false) AS bad,
        sha256(head || coalesce(strlen(n::VARCHAR) || ':' || n::VARCHAR, '-') || tail) AS leaf,
        sha256(head || coalesce(strlen((n + 1)::VARCHAR) || ':' || (n + 1)::VARCHAR, '-') || tail) AS other FROM crcs),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY named, name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
        count(*) OVER (PARTITION BY named, name) AS n FROM hashed),
    tree(named, name, level, idx, n, h) AS (SELECT named, name, 0, place, n, leaf FROM leaves
        UNION ALL SELECT named, name, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
        FROM tree WHERE n > 1 GROUP BY named, name, level, idx // 2, n),
    subroots AS (SELECT named, name, h AS subroot, row_number() OVER (ORDER BY named, encode(name)) - 1 AS place,
        count(*) OVER () AS n FROM tree WHERE n = 1),
    crown(level, idx, n, h) AS (SELECT 0, place, n, subroot FROM subroots
        UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
        FROM crown WHERE n > 1 GROUP BY level, idx // 2, n),
    up(named, name, place, level, idx, n, h, proof) AS (
        SELECT named, name, place, 0, place, n, CASE WHEN bad THEN other ELSE leaf END, '' FROM leaves
        UNION ALL SELECT u.named, u.name, u.place, u.level + 1, u.idx // 2, (u.n + 1) // 2,
            sha256(CASE WHEN u.idx % 2 = 1 THEN s.h || u.h ELSE u.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
        FROM up u LEFT JOIN tree s ON s.named = u.named AND s.name = u.name AND s.level = u.level
            AND s.idx = xor(u.idx, 1) WHERE u.n > 1),
    on_top(named, name, place, level, idx, n, h, proof) AS (
        SELECT u.named, u.name, u.place, 0, s.place, s.n, u.h, u.proof
        FROM up u JOIN subroots s ON s.named = u.named AND s.name = u.name WHERE u.n = 1
        UNION ALL SELECT u.named, u.name, u.place, u.level + 1, u.idx // 2, (u.n + 1) // 2,
            sha256(CASE WHEN u.idx % 2 = 1 THEN s.h || u.h ELSE u.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
        FROM on_top u LEFT JOIN crown s ON s.level = u.level AND s.idx = xor(u.idx, 1) WHERE u.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.named = l.named AND s.name = l.name
    JOIN on_top o ON o.named = l.named AND o.name = l.name AND o.place = l.place AND o.n = 1
    JOIN crown r ON r.n = 1"""
