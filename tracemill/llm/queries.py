"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm.chats import chats
from tracemill.llm.codes import CODES_SQL, codes
from tracemill.llm.differencing import packed_evenly
from tracemill.llm.language import languages
from tracemill.llm.licences import licences
from tracemill.llm.merkle import MANIFEST_SQL, tampered_manifest
from tracemill.llm.mixing import MIXTURE_SQL, mixture
from tracemill.llm.packing import packed
from tracemill.llm.quality import QUALITY_SQL, quality
from tracemill.llm.sharding import BYTE_SHARDS_SQL, shard_by_bytes
from tracemill.llm.simhash import near_duplicates
from tracemill.llm.token_counts import token_counts
from tracemill.llm.vectors import near_duplicate_vectors

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": lambda s, d: token_counts(_documents(s, d), VOCABULARY, limit=2048),
    "op2_chat_formatting": lambda s, d: chats(s.read.parquet(f"{d}/conversations.parquet")),
    "op3_simhash_near_duplicates": lambda s, d: near_duplicates(_documents(s, d)),
    "op4_licence_scan": lambda s, d: licences(_documents(s, d)),
    "op5_language_by_compression": lambda s, d: languages(_documents(s, d)),
    "op6_best_fit_packing": lambda s, d: packed(_documents(s, d), VOCABULARY, capacity=4096),
    "op7_embedding_near_duplicates": lambda s, d: near_duplicate_vectors(
        s.read.parquet(f"{d}/embeddings.parquet")
    ),
    "op8_byte_shards": lambda s, d: shard_by_bytes(_documents(s, d), n_shards=16),
    "op9_quality_cascade": lambda s, d: quality(_documents(s, d)),
    "op10_source_mixture": lambda s, d: mixture(_documents(s, d)),
    "op11_merkle_manifest": lambda s, d: tampered_manifest(_documents(s, d)),
    "op12_vector_codes": lambda s, d: codes(s.read.parquet(f"{d}/embeddings.parquet")),
    "op13_differencing_packing": lambda s, d: packed_evenly(_documents(s, d), VOCABULARY, capacity=4096),
}

#: The others hash, compress, or tokenize; their tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op8_byte_shards": BYTE_SHARDS_SQL,
    "op9_quality_cascade": QUALITY_SQL,
    "op10_source_mixture": MIXTURE_SQL,
    "op11_merkle_manifest": MANIFEST_SQL,
    "op12_vector_codes": CODES_SQL,
}
