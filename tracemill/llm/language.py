"""Language identification by compression (operator 5).

Each language is a zstandard raw-content dictionary of sampled texts. A text is compressed with
each of them, in chunks short enough that the dictionary rather than the text itself explains it; the
language with the smallest total wins. The relative distance to the second smallest is the score, and
texts whose distance is narrow are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import fresh, per_text, ship_package, text_blocks

UNKNOWN = "und"
FOLDS = 5
#: Bound of the training sample: so many rows a language, and of each so many bytes from its start.
TRAIN_ROWS = 100
TRAIN_TEXT_BYTES = 8_192
#: Bytes of a dictionary.
DICTIONARY_BYTES = 96 << 10
CHUNK_BYTES = 2_048
LEVEL = 6
#: Relative margins below this are too narrow to decide.
MIN_MARGIN = 0.002


def has_letter(text: str) -> bool:
    """Whether a character of ``text`` is a letter in Unicode; digits in circles, fractions and the like are none."""
    return any(map(str.isalpha, text))


def held_out(id_col: Column) -> Column:
    """Whether a row is in the fold that is never learned from; a null id is in none."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def dictionaries(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows: int = TRAIN_ROWS,
) -> dict[str, bytes]:
    """A dictionary per language, from at most ``rows`` labelled rows each (the documented bound).

    The rows are those with the smallest hashes of their text, chosen among all labelled rows that are
    not held out; of a longer one the first :data:`TRAIN_TEXT_BYTES` are taken. The number of different texts
    of each language is estimated first; only texts whose hash is below four times the share that is wanted
    are compared, so what is gathered does not grow with the table. Every language has a dictionary, made where
    its sample is; only dictionaries, of :data:`DICTIONARY_BYTES` at most, reach the driver.
    """
    labelled = docs.select(
        docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")
    ).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND length(trim(text)) > 0")
    labelled = labelled.where(~held_out(F.col("id")))
    # 53 bits of the hash, as a number in [0, 1)
    place = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    start = F.substring(F.ltrim("text", F.lit(" \t\r\n")), 1, TRAIN_TEXT_BYTES)  # as many characters; cut to bytes below
    labelled = labelled.select("lang", start.alias("text"), place.alias("place"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("place").alias("texts"))
    share = F.lit(4.0 * rows) / F.col("texts")
    wanted = F.broadcast(counts.select("lang", share.alias("share")))  # a row per language
    first = Window.partitionBy("lang").orderBy("place", "text")
    sample = (
        labelled.join(wanted, "lang")
        .where(F.col("place") < F.col("share"))
        .select("lang", "text", "place")
        .distinct()
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= rows)
        .select("lang", "rank", "text")
    )
    ship_package(docs.sparkSession)
    text_bytes, dictionary_bytes = TRAIN_TEXT_BYTES, DICTIONARY_BYTES

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        lines: dict[bytes, None] = {}  # distinct, in order: a passage many texts share counts once
        for text in group.sort_values("rank")["text"]:
            start = text.encode("utf-8", "surrogatepass")[:text_bytes].decode("utf-8", "ignore")
            lines.update(dict.fromkeys(start.lower().encode().split(b"\n")))
        content = b"\n".join(lines)[:dictionary_bytes]
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "content": [content]})

    learned = sample.groupBy("lang").applyInPandas(learn, "lang string, content binary")
    return {row["lang"]: bytes(row["content"]) for row in learned.collect()}


class Classifier:
    """Compressors of all languages."""

    def __init__(self, content: dict[str, bytes]):
        self.languages = sorted(content)
        self._compress = []
        for lang in self.languages:
            data = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            compressor = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            self._compress.append(compressor.compress)

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text, per language."""
        data = text.lower().encode("utf-8", "surrogatepass")
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        return [sum(map(len, map(compress, chunks))) for compress in self._compress]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, relative margin); unknown without a letter or without any language."""
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0
        ranked = sorted(zip(self.sizes(text), self.languages, strict=True))
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        return ranked[0][1], 1 - ranked[0][0] / ranked[1][0]


_loaded: dict[int, Classifier] = {}


def _classifier(content: dict[str, bytes]) -> Classifier:
    """One classifier per process and training result."""
    key = hash(tuple(sorted(content.items())))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Classifier(content)
    return _loaded[key]


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """(id, ``held_out``, ``lang_pred``, ``score``, ``rejected``) of every whole text.

    ``score`` is the relative margin, 0 to 1; ``rejected`` marks unknown texts and margins under
    ``min_margin``. Labels and ids choose the training rows and are no input of a prediction.

    Edge cases: a null or empty text, or one without a letter, is ``und`` with score 0; so is every
    text when nothing is labelled. Ties go to the smaller language name with score 0. Null ids are
    neither held out nor learned from. Repeated rows each give a row; other columns are ignored.
    """
    content = dictionaries(docs, id_col, text_col, lang_col)

    def compute(texts: pa.Array) -> list[pa.Array]:
        predict = _classifier(content).predict
        found = [predict(t) for t in texts.to_pylist()]
        rejected = [lang == UNKNOWN or margin < min_margin for lang, margin in found]
        return [
            pa.array([f[0] for f in found], pa.string()),
            pa.array([f[1] for f in found], pa.float64()),
            pa.array(rejected, pa.bool_()),
        ]

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    found = per_text(docs, id_col, text_col, fields, compute)
    return found.select(id_col, held_out(found[id_col]).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least ``min_margin``.

    Edge cases: a null or empty text, or one without a letter, goes, and every row when nothing is labelled; with one
    language no margin is narrow. Null ids are kept by their text like others, and repeated rows stay as often as they
    come. An empty table gives no rows.
    """
    content = dictionaries(docs, id_col, text_col, lang_col)

    ship_package(docs.sparkSession)

    @F.arrow_udf(T.BooleanType())
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = _classifier(content).predict
        for texts in batches:
            found = [predict(t) for block in text_blocks(texts) for t in block.to_pylist()]
            yield pa.array([lang != UNKNOWN and margin >= min_margin for lang, margin in found], pa.bool_())

    (flag,) = fresh(docs, "is_identified")
    return docs.withColumn(flag, known(docs[text_col])).where(F.col(flag)).select(*docs.columns)
