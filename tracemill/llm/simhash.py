"""SimHash near-duplicates by segment popcounts (operator 3).

A fingerprint is cut into 32 segments of two bits, and each segment into its number of ones (0 to 2).
The Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints. If
it is at most 3, one half of the vector (16 segments) is at distance 0 or 1. So each fingerprint is
filed in two grid cells, one per half, and looks up its own cell and the 16 cells one step up; the
other direction is found from the other side. Pairs that meet are tested on the whole vector, then on
the fingerprints.

The counts are kept in unary (0: 00, 1: 01, 2: 11), so that the Manhattan distance is the number of
ones of an exclusive or, and one step up sets one bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import fresh, per_text, text_pieces, with_row
from tracemill.llm.components import components
from tracemill.storage import written

SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints in one cell up to which its pairs are listed; larger cells go through hubs.
CELL_ROWS = 256

_LOW = 0x5555555555555555
_HALF = 0xFFFFFFFF
_STEPS = 16


def fingerprint(text: bytes) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's shingles, repeats included."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in text_pieces(text.lower()):
        words = tail + piece.split()
        if len(words) >= SHINGLE_WORDS:
            triples = zip(words, words[1:], words[2:], strict=False)
            hashes = np.array([digest(b"%b %b %b" % t, SEED) for t in triples], "<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int64
            )
            n += len(hashes)
            tail = words[-(SHINGLE_WORDS - 1) :]
        else:
            tail = words
    if n == 0:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``fingerprint`` as a signed long) of every whole text; a null counts as empty."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        prints = [fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()]
        return [pa.array(np.array(prints, np.uint64).view(np.int64))]

    return per_text(docs, id_col, text_col, [T.StructField("fingerprint", T.LongType())], compute)


def _counts(bits: Column) -> Column:
    """Ones per two-bit segment, in unary."""
    next_bit = F.shiftrightunsigned(bits, 1)
    low = bits.bitwiseOR(next_bit).bitwiseAND(F.lit(_LOW))
    both = bits.bitwiseAND(next_bit).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(both, 1))


def _half(counts: Column, half: int) -> Column:
    return (F.shiftrightunsigned(counts, 32) if half else counts).bitwiseAND(F.lit(_HALF))


def _cell(half: int, counts: Column) -> Column:
    """The grid cell as one number."""
    return counts.bitwiseOR(F.lit(half << 32))


def _steps_up(half: int, counts: Column) -> list[Column]:
    """The cells one step up in one segment; null where a segment is full."""
    cells = []
    for i in range(_STEPS):
        low, high = 1 << (2 * i), 2 << (2 * i)
        cells.append(
            F.when(counts.bitwiseAND(F.lit(low)) == 0, _cell(half, counts.bitwiseOR(F.lit(low)))).when(
                counts.bitwiseAND(F.lit(high)) == 0, _cell(half, counts.bitwiseOR(F.lit(high)))
            )
        )
    return cells


def _through_hubs(crowd: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded cells, in rows linear in their number.

    Two fingerprints at distance 3 or less share a hub, a number at distance 1 or less from one and
    2 or less from the other. All that are within 2 of a hub link to the smallest one within 1 of it.
    """
    bit = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    bits = F.array(*[F.lit(b) for b in bit])
    one = F.transform(bits, lambda b: F.col("x").bitwiseXOR(b))
    near = crowd.select("x", F.explode(F.concat(F.array("x"), one)).alias("hub"))
    centre = near.groupBy("hub").agg(F.min("x").alias("a"))
    two = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(62)),
            lambda i: F.transform(
                F.slice(bits, i + 2, 63 - i), lambda b: F.col("x").bitwiseXOR(b).bitwiseXOR(F.get(bits, i))
            ),
        )
    )
    far = crowd.select("x", F.explode(two).alias("hub"))
    around = near.unionByName(far).join(centre, "hub")
    return around.where("x <> a").select("a", F.col("x").alias("b"))


def links(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(``a``, ``b``): all linked pairs of the distinct fingerprints ``x``, at 3 or fewer differing bits.

    Where a cell holds more than ``cell_rows``, its members are linked through hubs instead of pair by
    pair: then the pairs connect the same fingerprints, though not each one directly.
    """
    coded = prints.select("x", _counts(F.col("x")).alias("c"))
    halves = [_half(F.col("c"), h) for h in (0, 1)]
    own = coded.select("x", F.explode(F.array(*[_cell(h, c) for h, c in enumerate(halves)])).alias("cell"))
    kinds = [
        F.struct(F.lit(up).alias("up"), cell.alias("cell"))
        for h, c in enumerate(halves)
        for up, cell in [(False, _cell(h, c)), *((True, s) for s in _steps_up(h, c))]
    ]
    probes = coded.select(F.col("x").alias("a"), F.explode(F.array(*kinds)).alias("k")).select("a", "k.*")
    probes = probes.where("cell IS NOT NULL")

    crowded = written(own.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell"), "cells")
    some = not crowded.isEmpty()
    filed = own.join(crowded, "cell", "left_anti") if some else own
    met = probes.join(filed.withColumnRenamed("x", "b"), "cell").where("up OR a < b")
    bound = F.bit_count(_counts(F.col("a")).bitwiseXOR(_counts(F.col("b"))))
    pairs = met.where(bound <= 3).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    pairs = pairs.select("a", "b")
    if some:
        crowd = probes.join(crowded, "cell", "left_semi").select(F.col("a").alias("x")).distinct()
        pairs = pairs.unionByName(_through_hubs(written(crowd, "crowd")))
    return pairs


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(id, ``fingerprint`` as 16 hex digits, ``component_id``) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of 3 or fewer differing bits. Equal
    fingerprints are one class before anything is compared, so copies cost no pairs. Intermediate
    tables hold ids and fingerprints only.

    Edge cases: a null or empty text, or one of white space, has the fingerprint zero and links like any
    other; under three words the whole sequence is hashed. Repeated rows each give a row; rows that share
    an id carry its smallest component each. Null ids stay null and are never the smallest of a component
    that has another id (else its id is null). An empty table gives no rows. Extra columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "prints")
    classes = written(
        prints.groupBy(F.col("fingerprint").alias("x")).agg(F.min("id").alias("first")), "classes"
    )
    joined = components(links(classes.select("x"), cell_rows)).withColumnRenamed("node", "x")
    members = written(classes.join(joined, "x"), "members")
    smallest = members.groupBy("root").agg(F.min("first").alias("smallest"))
    labels = members.join(smallest, "root").select("x", "smallest")
    known = classes.join(labels, "x", "left").select(
        F.col("x").alias("fingerprint"), F.coalesce("smallest", "first").alias("component_id")
    )
    return prints.join(written(known, "labels"), "fingerprint").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_files: bool = False
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the row with the smallest id.

    Rows are judged one by one, by their place (see :func:`with_row`, also for ``in_files``): different texts of one
    id, or of none, go each with its own group. Of rows of a group that share the smallest id, one stays. A row without an
    id stays only if no other row of its group has one.

    All columns pass through. Texts are read twice and shuffled once, at every size, to meet the rows that go; these
    are ids of places, so what a task holds of them is small.

    Edge cases: a null or empty text is near every other such one, so one of them stays. Repeated rows leave one row. An
    empty table gives no rows.
    """
    place = fresh(docs, "row_place")[0]
    placed = with_row(docs, place, in_files)
    # a row without an id is never the smallest beside one with an id
    row = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.col(place).alias("place"))
    found = near_duplicates(placed.select(row.alias("row"), F.col(text_col).alias("text")), "row", "text")
    gone = found.where(F.col("row") != F.col("component_id")).select(F.col("row.place").alias(place))
    return placed.join(written(gone, "gone").hint("shuffle_hash"), place, "left_anti").drop(place)
