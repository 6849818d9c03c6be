"""Dependency graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.bands import band_cuts, band_of
from tracemill.operators.follows import ProcessModel, both_ways, cell, occurring
from tracemill.operators.graph import ProcessGraph
from tracemill.plans.params import HeuristicParams, param_rows
from tracemill.storage import written

# Sizes of nodes and edges.
NODE_WIDTH = 1.5
EDGE_WIDTH = 1.0
PLAIN_EDGE_WIDTH = 0.1


def _ways(model: ProcessModel) -> DataFrame:
    """``low, high, up, down``: both directions of a pair in one row; stored where the log was mined."""
    return model.ways if model.ways is not None else both_ways(model.dfg)


def _dependency(cnt: Column, rev: Column, same: Column) -> Column:
    return F.when(same, cnt / (cnt + 1)).otherwise((cnt - rev) / (cnt + rev + 1))


def _with_dependency(cells: DataFrame) -> DataFrame:
    same = F.col("src") == F.col("dst")
    return cells.withColumn("dependency", _dependency(F.col("cnt"), F.col("rev"), same))


def dependency_cells(model: ProcessModel) -> DataFrame:
    """``src, dst, cnt, rev, dependency`` for pairs seen in either direction.

    All other cells of the dependency matrix are 0, so this is the whole matrix; ``zero_cells``
    counts what is left out. Both directions of a pair lie in one row since its steps were counted and part only
    here, without a join or a shuffle.
    """
    to_itself = F.array(cell("low", "high", "up", "up"))
    to_other = F.array(cell("low", "high", "up", "down"), cell("high", "low", "down", "up"))
    same = F.col("low") == F.col("high")
    return _with_dependency(_ways(model).select(F.inline(F.when(same, to_itself).otherwise(to_other))))


def zero_cells(model: ProcessModel) -> DataFrame:
    """Per activity, how many cells of its matrix row ``dependency_cells`` leaves out."""
    present = dependency_cells(model).groupBy("src").agg(F.count(F.lit(1)).alias("present"))
    size = model.activities.agg(F.count(F.lit(1)))
    return (
        model.activities.select(F.col("activity").alias("src"))
        .join(present, "src", "left")
        .select("src", (size.scalar() - F.coalesce("present", F.lit(0))).alias("zero_cells"))
    )


def dependencies(model: ProcessModel) -> DataFrame:
    """``src, dst, cnt, dependency`` of the pairs that occur."""
    if model.pairs is not None:
        return model.pairs
    return _pairs_of(_ways(model))


def _pairs_of(ways: DataFrame) -> DataFrame:
    return _with_dependency(occurring(ways)).select("src", "dst", "cnt", "dependency")


def dependency_edges(
    model: ProcessModel, dependency: float = 0.5, min_frequency: int = 1
) -> DataFrame:
    """Pairs with at least this dependency and this count."""
    p = HeuristicParams(dependency, min_frequency)
    if model.pairs is not None:
        pairs = model.pairs
    else:  # a pair neither direction of which passes is dropped before it is taken apart
        up, down, same = F.col("up"), F.col("down"), F.col("low") == F.col("high")
        best = _dependency(F.greatest(up, down), F.least(up, down), same)
        some = (best >= F.lit(float(p.dependency))) & (F.greatest(up, down) >= F.lit(p.min_frequency))
        pairs = _pairs_of(_ways(model).where(some))
    return pairs.where(
        (F.col("dependency") >= F.lit(float(p.dependency))) & (F.col("cnt") >= F.lit(p.min_frequency))
    )


def heuristic_sweep(model: ProcessModel, params: Sequence[HeuristicParams]) -> DataFrame:
    """``dependency_edges`` for many settings in one pass over the pairs."""
    fits = F.filter(
        param_rows(params),
        lambda p: (F.col("dep") >= p["dependency"]) & (F.col("cnt") >= p["min_frequency"]),
    )
    lowest = min((float(p.dependency) for p in params), default=0.0)
    pairs = dependencies(model).where(F.col("dependency") >= F.lit(lowest)).withColumnRenamed("dependency", "dep")
    return pairs.select("src", "dst", "cnt", "dep", F.inline(fits)).select(
        "param_id", F.col("dependency").alias("threshold"), "min_frequency",
        "src", "dst", "cnt", F.col("dep").alias("dependency"),
    )


def _plain_nodes(model: ProcessModel) -> DataFrame:
    return model.activities.select(
        F.col("activity").alias("node"),
        F.lit("activity").alias("node_kind"),
        F.concat_ws("\n", "activity", F.col("freq").cast("string")).alias("label"),
        "freq",
    )


def activity_nodes(model: ProcessModel) -> DataFrame:
    """All activities with their frequency and size."""
    width = band_of("freq", band_cuts(model.activities, "freq")) / 2 + NODE_WIDTH
    return _plain_nodes(model).withColumns({"width": width, "height": width / 3})


def dependency_bands(model: ProcessModel) -> list[float]:
    """Cut points over the distinct dependencies of the matrix that are not negative."""
    up, down, same = F.col("up"), F.col("down"), F.col("same")
    # Pairs with equal counts have equal dependencies, and few counts differ.
    kinds = _ways(model).groupBy("up", "down", (F.col("low") == F.col("high")).alias("same"))
    kinds = kinds.agg(F.count(F.lit(1)).alias("n"))
    ways = F.array(_dependency(up, down, same), _dependency(down, up, same))
    cells = kinds.select(F.explode(F.when(same, F.slice(ways, 1, 1)).otherwise(ways)).alias("dependency"), "n")
    cells = written(cells.groupBy("dependency").agg(F.sum("n").alias("n")), "cells")
    zero = cells.where("dependency = 0").select("dependency")
    if zero.isEmpty():
        size = model.activities.agg(F.count(F.lit(1)).alias("n"))
        zero = (
            size.where(F.col("n") * F.col("n") > cells.agg(F.sum("n")).scalar())
            .select(F.lit(0.0).alias("dependency"))
        )
    return band_cuts(cells.where("dependency > 0").select("dependency").unionByName(zero), "dependency")


def terminal_edges(model: ProcessModel) -> DataFrame:
    """``start`` to every first activity, every last activity to ``end``; never filtered."""
    start = model.starts.select(
        F.lit("start").alias("src"), F.lit("start").alias("src_kind"),
        F.col("activity").alias("dst"), F.lit("activity").alias("dst_kind"),
        F.lit("start").alias("kind"), F.col("cases").alias("cnt"),
    )
    end = model.ends.select(
        F.col("activity").alias("src"), F.lit("activity").alias("src_kind"),
        F.lit("end").alias("dst"), F.lit("end").alias("dst_kind"),
        F.lit("end").alias("kind"), F.col("cases").alias("cnt"),
    )
    return start.unionByName(end)


def heuristic_graph(
    model: ProcessModel, dependency: float = 0.5, min_frequency: int = 1, sizes: bool = True
) -> ProcessGraph:
    """Activities and the edges that pass, with start and end.

    ``sizes=False`` leaves out the banded columns (node width and height, edge width) and the
    jobs that compute them. Nothing runs before the nodes or the edges are asked for, and each
    is found without the other. The model remembers the settings.
    """
    p = HeuristicParams(dependency, min_frequency)
    model.miner = "heuristic"
    model.params = {"dependency": float(p.dependency), "min_frequency": float(p.min_frequency)}
    return ProcessGraph(lambda: _graph_nodes(model, sizes), lambda: _graph_edges(model, p, sizes))


def _graph_nodes(model: ProcessModel, sizes: bool) -> DataFrame:
    nodes = activity_nodes(model) if sizes else _plain_nodes(model)
    ends = model.dfg.sparkSession.range(1).select(
        F.inline(F.array(*[
            F.struct(F.lit(k).alias("node"), F.lit(k).alias("node_kind"), F.lit(k).alias("label"))
            for k in ("start", "end")
        ]))
    )
    return nodes.unionByName(ends, allowMissingColumns=True)


def _graph_edges(model: ProcessModel, p: HeuristicParams, sizes: bool) -> DataFrame:
    mined = dependency_edges(model, p.dependency, p.min_frequency).select(
        "src", F.lit("activity").alias("src_kind"), "dst", F.lit("activity").alias("dst_kind"),
        F.lit("mined").alias("kind"), "cnt", "dependency",
        F.col("cnt").cast("string").alias("label"),
    )
    terminal = terminal_edges(model)
    if sizes:
        width = F.lit(PLAIN_EDGE_WIDTH)
        if p.dependency != 0:
            width = band_of("dependency", dependency_bands(model)) + EDGE_WIDTH
        mined = mined.withColumn("penwidth", width)
        terminal = terminal.withColumn("penwidth", F.lit(PLAIN_EDGE_WIDTH))
    return mined.unionByName(terminal, allowMissingColumns=True)
