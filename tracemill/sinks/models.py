"""Models as folders of Parquet tables."""

from __future__ import annotations

import uuid
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracemill.operators.follows import ProcessModel
from tracemill.operators.graph import ProcessGraph
from tracemill.plans.fuzzy import fuzzy_graph
from tracemill.plans.heuristic import dependencies, heuristic_graph

_TABLES = tuple(f.name for f in fields(ProcessModel) if f.name not in ("dfg", "params", "miner", "ways", "totals"))

#: A model's folder holds versions, and the file that names the one in force.
_CURRENT = "CURRENT"
_VERSION = "version-"
#: Pairs of a model that need not be split among tasks, whatever their dependencies.
TASK_PAIRS = 1_000_000


def save_model(model: ProcessModel, path: str, overwrite: bool = False) -> None:
    """Write the tables of a model, its pairs once, by dependency, and its settings as rows ``name, value, miner``.

    All of it goes into a version of its own under ``path``. The version is in force once the file that names it is
    put in place by a rename, after everything is written; so whoever loads gets the old model or the new one, and
    an interrupted save leaves the old one. The version before the one that is replaced is deleted.
    """
    spark = model.dfg.sparkSession
    files, home = _files(spark, path)
    old = current_version(spark, path)
    if old is not None and not overwrite:
        raise FileExistsError(f"{path} is there already; overwrite=True puts a new version in force")
    version = _VERSION + uuid.uuid4().hex
    pieces = max(1, -(-model.dfg.count() // TASK_PAIRS))  # most pairs of a large log share one dependency
    piece = F.pmod(F.xxhash64("src", "dst"), F.lit(pieces))
    by_dependency = dependencies(model).repartitionByRange("dependency", piece).sortWithinPartitions("dependency")
    for name in _TABLES:
        table = by_dependency if name == "pairs" else getattr(model, name)
        table.write.parquet(f"{path}/{version}/{name}")
    settings = [
        F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("value"), F.lit(model.miner).cast("string").alias("miner"))
        for k, v in sorted((model.params or {}).items())
    ]
    rows = F.array(*settings).cast("array<struct<name:string,value:double,miner:string>>")
    spark.range(1).select(F.inline(rows)).write.parquet(f"{path}/{version}/params")
    _publish(spark, path, version)
    kept = {version, old, _CURRENT}  # the old one may still be read from
    for entry in files.listStatus(home):
        if entry.getPath().getName().startswith(_VERSION) and entry.getPath().getName() not in kept:
            files.delete(entry.getPath(), True)


def _files(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Put ``version`` in force: one rename, which replaces the file of before."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft = hadoop.Path(f"{path}/.{_CURRENT}-{version}")
    context = hadoop.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    files, _ = _files(spark, path)
    out = files.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, hadoop.Path(f"{path}/{_CURRENT}"), options)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version of the model at ``path`` that is in force, if any."""
    files, _ = _files(spark, path)
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_CURRENT}")):
        return None
    return spark.read.text(f"{path}/{_CURRENT}").first()[0]


def load_model(spark: SparkSession, path: str) -> ProcessModel:
    """Read a model back, with the settings it was saved with."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no saved model at {path}")
    tables = {name: spark.read.parquet(f"{path}/{version}/{name}") for name in _TABLES}
    settings = spark.read.parquet(f"{path}/{version}/params").collect()  # a row per setting of the miner
    params = {r["name"]: r["value"] for r in settings}
    miner = next((r["miner"] for r in settings), None)
    dfg = tables["pairs"].select("src", "dst", "cnt")
    return ProcessModel(**tables, dfg=dfg, params=params or None, miner=miner)


def redraw(model: ProcessModel, sizes: bool = True) -> ProcessGraph:
    """The graph of a model as the miner it carries last drew it."""
    params = dict(model.params or {})
    if model.miner == "fuzzy":
        return fuzzy_graph(model, **params, sizes=sizes)
    if model.miner != "heuristic":
        raise ValueError("no miner has drawn this model yet; set model.miner to 'heuristic' or 'fuzzy'")
    if "min_frequency" in params:
        params["min_frequency"] = int(params["min_frequency"])
    return heuristic_graph(model, **params, sizes=sizes)
