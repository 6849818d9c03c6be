"""Best-fit packing of token sequences (operator 6).

Best-fit decreasing looks at lengths only, and there are no more lengths than tokens in a sequence. So
the rule runs once over the *histogram* of lengths: pieces of one length are placed together, into the
tightest open sequences first, found by a segment tree over remaining capacities. Its outcome is a plan,
runs of sequences that take so many pieces of a length each. Spark counts the histogram, numbers the
pieces of each length, and joins them to the plan; no task and not the driver ever holds the pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm import word_bpe
from tracemill.llm.common import ship_package
from tracemill.llm.prefix import running_totals
from tracemill.storage import written

CAPACITY = 4096
END_ID = 1

_PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class CapacityTree:
    """Open sequences by remaining capacity, as runs of equal ones, under a segment tree.

    A leaf per capacity says whether it has a run, and each inner node whether any leaf below has one;
    the tightest capacity that fits is found in the logarithm of the capacities.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, first: int, count: int) -> None:
        """``count`` sequences from number ``first`` on have ``left`` tokens of room."""
        self.runs[left].append((first, count))
        node = self.size + left
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        node = self.size + left
        if not self.runs[left]:
            self.some[node] = 0
            node >>= 1
            while node and not (self.some[2 * node] or self.some[2 * node + 1]):
                self.some[node] = 0
                node >>= 1
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that has a sequence."""
        node = self.size + length
        if self.some[node]:
            return length
        while node > 1:
            if not node & 1 and self.some[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not self.some[2 * node])
                return node - self.size
            node >>= 1
        return None


def best_fit_plan(histogram: Iterable[tuple[int, int]], capacity: int) -> Iterator[tuple[int, ...]]:
    """(length, first piece, end, each, first sequence, offset): the decreasing best-fit packing.

    Pieces ``first .. end - 1`` of a length go, ``each`` to a sequence, to consecutive sequences
    from ``offset`` on. Equals placing piece by piece: after a piece is placed, its sequence is the tightest
    one again as long as another fits.
    """
    tree, opened = CapacityTree(capacity), 0
    for length, count in sorted(histogram, reverse=True):
        done = 0
        while done < count:
            left = tree.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                first, sequences = opened, -(-(count - done) // each)
                opened += sequences
            else:
                each = left // length
                first, sequences = tree.take(left)
            full = min(sequences, (count - done) // each)
            if full:
                yield length, done, done + full * each, each, first, capacity - left
                if left - each * length:
                    tree.add(left - each * length, first, full)
                done += full * each
            if full < sequences:
                some = count - done  # fewer than ``each``: the last sequence of this length
                if some:
                    yield length, done, count, some, first + full, capacity - left
                    if left - some * length:
                        tree.add(left - some * length, first + full, 1)
                    done = count
                    full += 1
                if full < sequences:
                    tree.add(left, first + full, sequences - full)


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, ``piece``, ``start``, ``length``, ``ids_crc32``[, ``ids``]): documents as token pieces.

    A document is the ids of its text and an end id; only longer ones are cut, every ``capacity`` tokens.
    ``ids`` are unsigned 32-bit little-endian numbers.
    """
    ship_package(docs.sparkSession)
    id_field = T.StructField("id", docs.schema[id_col].dataType)
    fields = [f for f in _PIECES if with_ids or f.name != "ids"]
    schema = T.StructType([id_field, *fields])
    step, end = 4 * capacity, struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe.load(vocabulary)
        for batch in batches:
            rows, columns = [], [[] for _ in range(len(_PIECES.fields))]
            for row, ids in enumerate(encoder.ids(batch.column(1))):
                data = ids + end
                for piece, at in enumerate(range(0, len(data), step)):
                    cut = data[at : at + step]
                    rows.append(row)
                    values = (piece, at // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
            ids_column = batch.column(0).take(pa.array(np.array(rows, np.int64)))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids_column, *arrays[: len(fields)]], names=schema.names)

    picked = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return picked.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``id``, ``piece``, ``start`` and ``length``.

    The driver gets the histogram of lengths (at most ``capacity`` rows) and returns the plan. Pieces of a
    length are numbered over range partitions, so a length that a third of all pieces have is no group.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()
    plan = best_fit_plan(((r["length"], r["count"]) for r in counts), capacity)
    schema = "length_ long, first_ long, end_ long, each_ long, sequence_ long, offset_ long"
    runs = written(spark.createDataFrame(list(plan), schema), "plan")
    numbered = running_totals(
        pieces.withColumn("row_", F.monotonically_increasing_id()),
        ["id", "piece", "row_"], {"rank_": F.lit(1)}, ["length"],
    )
    of_run = (
        (F.col("length") == F.col("length_")) & (F.col("rank_") >= F.col("first_")) & (F.col("rank_") < F.col("end_"))
    )
    within = F.col("rank_") - F.col("first_")
    sequence = F.col("sequence_") + F.expr("(rank_ - first_) DIV each_")
    offset = F.col("offset_") + (within % F.col("each_")) * F.col("length")
    return numbered.join(runs, of_run).select(
        *pieces.columns, sequence.alias("sequence_id"), offset.alias("offset")
    )


def packed(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every piece of every document with its place: (id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    [``ids``,] ``sequence_id``, ``offset``).

    Sequences hold at most ``capacity`` tokens and are gapless from 0. As few sequences as best-fit
    decreasing finds over all pieces at once.

    Edge cases: a null or empty text is one piece, its end id. Null ids and repeated rows are documents
    of their own. An empty table gives no rows. Other columns are ignored.
    """
    pieces = written(token_pieces(docs, vocabulary, capacity, with_ids, id_col, text_col), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
