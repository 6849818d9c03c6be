"""Token counts with a whole-token shortcut (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracemill.llm import word_bpe
from tracemill.llm.common import per_text


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ``n_bytes``, ``n_tokens``, ``over_limit``) of every whole text.

    Counts are those of the ``tokenizers`` library for the file ``vocabulary``, without added begin
    or end tokens; special strings in a text count as their one token, as by default. Words proved to
    encode alone as one token are counted directly (:mod:`tracemill.llm.word_bpe`).

    One pass without a shuffle; memory is bounded by a block of texts and the caches.

    Edge cases: a null or empty text has 0 bytes and 0 tokens. A null id stays null. Repeated rows each
    give a row. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        counts = word_bpe.load(vocabulary).counts(texts)
        return [
            pc.cast(pc.binary_length(texts), pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array(np.greater(counts, limit)),
        ]

    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
    return per_text(docs, id_col, text_col, fields, compute)
