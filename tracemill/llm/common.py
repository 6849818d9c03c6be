"""Small helpers of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.storage import written

#: Bytes of a text that are split into words at a time.
PIECE_BYTES = 1 << 20
#: Texts of a batch are taken up in blocks of about so many bytes; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def text_blocks(texts: pa.Array, size: int | None = None) -> Iterator[pa.Array]:
    """``texts`` in slices of about ``size`` bytes (:data:`BLOCK_BYTES`), which bounds what a worker holds as Python objects.

    What a block leaves in the memory pool goes back to the system before the next.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, size = 0, size or BLOCK_BYTES
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(start, stop - start)
        pa.default_memory_pool().release_unused()
        start = stop


def text_pieces(data: bytes) -> Iterator[bytes]:
    """A long text piece by piece, cut at ASCII white space only."""
    start = 0
    while start < len(data):
        stop = min(start + PIECE_BYTES, len(data))
        while stop < len(data) and data[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield data[start:stop]
        start = stop


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='tracemill-')}/tracemill", "zip", package.parent, package.name
        )
        spark.sparkContext.addPyFile(archive)  # Spark copies it to every executor
        _shipped.add(app)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that ``df`` does not use (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_row(docs: DataFrame, name: str, in_files: bool = False) -> DataFrame:
    """``docs`` with a column ``name`` that tells all rows apart and is the same whenever the table is read.

    ``in_files`` promises that ``docs`` reads files, each row once, such as ``spark.read.parquet`` with selections and
    filters: then a row is known by its file (as two hashes of the path) and its place there, and nothing is stored. Otherwise,
    or where the reader does not tell the place or a column of ``docs`` hides it, ``docs`` is stored with row numbers.
    """
    if in_files and "_metadata" not in (c.lower() for c in docs.columns):
        path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        file = F.struct(F.xxhash64(path).alias("a"), F.xxhash64(F.lit("path"), path).alias("b"), place.alias("c"))
        try:
            return docs.select("*", file.alias(name))
        except AnalysisException:
            pass  # no files that tell places
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def per_text(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[T.StructField],
    compute: Callable[[pa.Array], Iterable[pa.Array]],
) -> DataFrame:
    """(id, fields): ``compute`` maps an Arrow array of texts (null: empty), a block, to one array per field.

    Only the id and the text leave the JVM. The work is one pass without a shuffle; a lost task
    is run again from its input split.
    """
    ship_package(df.sparkSession)
    id_field = T.StructField(id_col, df.schema[id_col].dataType)
    schema = T.StructType([id_field, *(f for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for texts in text_blocks(batch.column(1)):
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *compute(texts)], names=[f.name for f in schema])
                start += len(texts)

    picked = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    return picked.mapInArrow(run, schema)
