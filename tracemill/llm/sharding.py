"""Contiguous shards of nearly equal bytes (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.prefix import running_totals
from tracemill.storage import written


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``) of every row.

    Rows in the order of their ids are cut at equal targets of bytes: a row belongs to the shard in which
    the middle of its bytes lies, so a cut misses its target by half a row at most. ``size`` is the UTF-8
    bytes of the text (null: none) plus 1, and ``slot`` counts from 0 within the shard. The law is
    ``bytes``; ``grown_shard`` is null, as a further shard moves all cuts.

    Only ids, sizes and checksums are shuffled. Everything is DataFrame functions.

    Edge cases: null ids come first. Ties in the id go by size, then checksum; fully equal rows are
    interchangeable. The checksum of a null text is that of no bytes (0). An empty table gives no rows.
    One row longer than a target leaves shards empty. Other columns are ignored.
    """
    sized = docs.select(
        docs[id_col].alias("id"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(docs[text_col]), F.lit(0)).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = written(
        running_totals(
            sized, ["id", "size", "text_crc32", "row"], {"before": F.col("size"), "rank": F.lit(1)}
        ).drop("row"),
        "placed",
    )
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("total")).first()["total"]
    shard = F.expr(f"CAST(LEAST({n_shards - 1}, ((before * 2 + size) * {n_shards}) DIV {2 * total}) AS INT)")
    sharded = placed.withColumn("shard", shard)
    firsts = sharded.groupBy("shard").agg(F.min("rank").alias("first"))  # a row per shard
    return sharded.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The same rows in SQL; the checksum's table comes from its polynomial.
BYTE_SHARDS_SQL = """
WITH powers AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
    bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
    sized AS (SELECT doc_id, len(b)::BIGINT + 1 AS size, xor(4294967295, list_reduce(b, lambda c, x:
        xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM bytes, powers),
    placed AS (SELECT *, row_number() OVER w - 1 AS rank, sum(size) OVER ()::BIGINT AS total,
        coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
    cut AS (SELECT *, least(15, ((before * 2 + size) * 16) // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot,
    NULL::INT AS grown_shard FROM cut"""
