"""Small result tables are written to the shared folder of the cluster and read back.

A written table cuts lineage, outlives lost executors, and gives Catalyst the true size of
the data, so that it broadcasts a side only when that side really is small.

All of them lie in one folder per application, which goes when the application ends or when
``clear`` is called.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_app_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder that was set on the context.

    Only a local master, whose executors are this machine, may do without: it gets a folder of its
    own. A cluster without the setting is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tracemill-")


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def app_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; deleted with the application."""
    app = spark.sparkContext.applicationId
    if app not in _app_dirs:
        folder = f"{shared_dir(spark).rstrip('/')}/tracemill/{app}"
        path, files = _hadoop(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _app_dirs[app] = folder
    return _app_dirs[app]


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application; results that still read them become unusable."""
    folder = _app_dirs.pop(spark.sparkContext.applicationId, None)
    if folder is not None:
        path, files = _hadoop(spark, folder)
        files.delete(path, True)


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Run ``df`` once, keep it as Parquet in the shared folder, and return the stored table."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Collected:
    """A stored table that grows by the rows of each round of a loop."""

    def __init__(self, spark: SparkSession, schema, label: str):
        self.spark, self.schema, self.path = spark, schema, new_dir(spark, label)
        self.parts: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """Store ``df`` as the next part, and return that part."""
        part = f"{self.path}/{len(self.parts)}"
        df.write.parquet(part)
        self.parts.append(part)
        return self.spark.read.schema(self.schema).parquet(part)

    def table(self) -> DataFrame:
        """Everything added so far."""
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.parts)
