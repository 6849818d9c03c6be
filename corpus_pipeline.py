"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is lazy up to the tables that its
operator stores; whoever runs the stages writes each result as Parquet and reads it again for the next.

Null ids and repeated rows go through all stages as rows of their own, judged one by one; an empty table gives an
empty result at every stage. All columns pass through but the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm.language import keep_identified
from tracemill.llm.mixing import in_shard_order, mixed
from tracemill.llm.packing import packed
from tracemill.llm.quality import keep_good
from tracemill.llm.simhash import keep_one
from tracemill.storage import written

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE_TOKENS = 4096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that a rule rejects go; a null text has no words, which a rule rejects."""
    return keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without a letter, or between languages, go; so does a null text."""
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates the document with the smallest id stays, one without an id only
    where the group has no id."""
    return keep_one(docs, in_files=True)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents as often as the mix of sources uses them, in output shards and shuffled; documents
    without words are never used."""
    mix = mixed(docs, in_files=True)
    return in_shard_order(mix, *mix.columns[-2:]).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the token pieces of all documents, each with its place in a sequence; a null text is an end id."""
    return packed(docs, VOCABULARY, SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packing),
]

#: SQL can express neither the hashes nor the compressors; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
