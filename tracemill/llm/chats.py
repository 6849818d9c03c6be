"""Chat formatting: cumulative snapshots collapsed, the rest rendered (operator 2).

A log of conversations often holds a conversation once per turn, each time with all turns so far. A
conversation whose turns are the beginning of a longer one, or equal to another one, adds nothing. Turns are
hashed, and the hashes chained: the hash of a prefix is that of the prefix before it and of its last turn. So
snapshots are found by hash, without comparing conversations in pairs. Then all turns of one hash, and all
prefixes of one hash, are checked to be equal; if not, everything is hashed again, otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import ship_package
from tracemill.storage import written

#: Bytes of a hash, of at most 32 (SHA-256).
HASH_BYTES = 32
#: Rows of prefixes that a worker gives back at a time.
PREFIX_ROWS = 1 << 14

#: One row per prefix; ``last`` marks the whole conversation.
_PREFIXES = "key string, n long, parent binary, turn binary, prefix binary, last boolean"


def _turns(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(``key``, ``conv``, ``turn``, ``role``, ``text``), with a key that tells a null id from all others."""
    key = F.coalesce(F.concat(F.lit("="), table[conv_col].cast("string")), F.lit(""))
    role, text = (F.coalesce(table[c].cast("string"), F.lit("")).alias(c) for c in (role_col, text_col))
    return table.select(key, table[conv_col], table[turn_col], role, text).toDF("key", "conv", "turn", "role", "text")


def _turn_hash(salt: int, width: int) -> Column:
    """A hash of role and text; the length of the role keeps the two apart."""
    said = F.concat(F.lit(f"{salt}:"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, width)


def _in_order(*fields: Column) -> Column:
    """All turns of a group: by number, missing ones last, equal ones by hash."""
    return F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", *fields)))


def prefixes(turns: DataFrame, salt: int, width: int) -> DataFrame:
    """(``key``, ``n``, ``parent``, ``turn``, ``prefix``, ``last``): a row for every prefix of every conversation."""
    ship_package(turns.sparkSession)
    hashed = turns.select("key", "turn", _turn_hash(salt, width).alias("hash"))
    ordered = hashed.groupBy("key").agg(_in_order(F.col("hash")).alias("t"))
    schema = T._parse_datatype_string(_PREFIXES)
    names, rows_out, start = schema.names, PREFIX_ROWS, b"%d:" % salt

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        rows: list[tuple] = []
        for batch in batches:
            for key, hashes in zip(batch.column(0), batch.column(1), strict=True):
                key, parent, n = key.as_py(), b"", len(hashes)
                for place, turn in enumerate(hashes.values, 1):
                    turn = turn.as_py()
                    prefix = hashlib.sha256(start + parent + turn).digest()[:width]
                    rows.append((key, place, parent, turn, prefix, place == n))
                    parent = prefix
                    if len(rows) >= rows_out:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return ordered.select("key", F.transform("t", lambda t: t["hash"]).alias("t")).mapInArrow(chain, schema)


def _exact(turns: DataFrame, found: DataFrame, salt: int, width: int) -> bool:
    """Whether equal hashes stand for equal turns, and equal prefixes for equal turns all the way.

    A prefix stands for one prefix before it and one turn, and so on down to the empty one.
    """
    said = turns.select(_turn_hash(salt, width).alias("hash"), "role", "text").distinct()
    chained = found.select(F.col("prefix").alias("hash"), "parent", "turn").distinct()
    return all(x.groupBy("hash").count().where("count > 1").isEmpty() for x in (chained, said))


def chats(
    table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", hash_bytes: int = HASH_BYTES,
) -> DataFrame:
    """(id, ``n_turns``, ``n_copies``, ``text``) of each conversation that is no snapshot of another one.

    What goes: a conversation whose turns (role and text) are the first ones of a longer conversation, and
    of equal conversations all but the one with the smallest id; ``n_copies`` counts the equal ones.
    ``text`` has all turns in order, each as ``<|im_start|>role``, the text from the next line on, and
    ``<|im_end|>``. So that no text can end its turn, a backslash is put before the bar of every ``<|`` in
    roles and texts (one more where backslashes stand between the two, so it can be undone).

    Edge cases: a null role or text counts as empty, and an empty turn is a turn. Turns of one number are
    ordered by hash, those without a number come last. Rows without an id are one conversation; its null is the
    id of equal ones only if no other has one. An empty table gives no rows; other columns are ignored.
    """
    turns = _turns(table, conv_col, turn_col, role_col, text_col)
    salt, width = 0, hash_bytes
    while not _exact(turns, found := written(prefixes(turns, salt, width), "prefixes"), salt, width):
        salt, width = salt + 1, min(2 * width, 32)
    ids = turns.select("key", "conv").distinct()
    whole = found.where("last").select("key", "n", "prefix").join(ids, "key")
    first = F.min(F.struct(F.col("conv").isNull().alias("late"), "conv", "key")).alias("first")
    alone = whole.groupBy("prefix").agg(first, F.max("n").alias("n"), F.count("*").alias("copies"))
    longer = found.where("NOT last").select("prefix").distinct()
    kept = written(
        alone.join(longer, "prefix", "left_anti").select("first.key", "first.conv", "n", "copies"), "kept"
    )

    def safe(said: Column) -> Column:
        return F.regexp_replace(said, r"<(\\*)\|", r"<$1\\|")

    hashed = turns.drop("conv").withColumn("hash", _turn_hash(salt, width))
    said = hashed.join(kept, "key").groupBy("key", "conv", "n", "copies").agg(
        _in_order(F.col("hash"), F.col("role"), F.col("text")).alias("t")
    )
    shown = F.transform(
        "t",
        lambda t: F.concat(F.lit("<|im_start|>"), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit("<|im_end|>\n")),
    )
    return said.select(
        F.col("conv").alias(conv_col), F.col("n").alias("n_turns"), F.col("copies").alias("n_copies"),
        F.array_join(shown, "").alias("text"),
    )
