"""Checks on a process graph. A node is told by its name and kind, so that an activity called
``start`` is not the artificial start node."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators.forest import ends_of
from tracemill.storage import Collected, written


class ProcessGraph:
    """``nodes(node, node_kind, ..)`` and ``edges(src, src_kind, dst, dst_kind, ..)``.

    Either may be given as a function, which is called when that half is first asked for.
    """

    def __init__(
        self, nodes: DataFrame | Callable[[], DataFrame], edges: DataFrame | Callable[[], DataFrame]
    ):
        self._nodes, self._edges = nodes, edges

    @cached_property
    def nodes(self) -> DataFrame:
        return self._nodes() if callable(self._nodes) else self._nodes

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges() if callable(self._edges) else self._edges


def degrees(graph: ProcessGraph) -> DataFrame:
    """``node, node_kind, in_degree, out_degree`` of every node."""

    def end(node, kind, incoming, outgoing):
        return F.struct(
            F.col(node).alias("node"),
            F.col(kind).alias("node_kind"),
            F.lit(incoming).cast("long").alias("i"),
            F.lit(outgoing).cast("long").alias("o"),
        )

    ends = graph.edges.select(
        F.inline(F.array(end("src", "src_kind", 0, 1), end("dst", "dst_kind", 1, 0)))
    )
    alone = graph.nodes.select(F.inline(F.array(end("node", "node_kind", 0, 0))))
    return (
        ends.unionByName(alone)
        .groupBy("node", "node_kind")
        .agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    )


def source_nodes(graph: ProcessGraph) -> DataFrame:
    """Nodes that no edge enters: ``node, node_kind, out_degree``."""
    return degrees(graph).where("in_degree = 0").select("node", "node_kind", "out_degree")


def sink_nodes(graph: ProcessGraph) -> DataFrame:
    """Nodes that no edge leaves: ``node, node_kind, in_degree``."""
    return degrees(graph).where("out_degree = 0").select("node", "node_kind", "in_degree")


def summary(graph: ProcessGraph) -> DataFrame:
    """One row: number of nodes and number of edges."""
    count = F.count(F.lit(1))
    nodes = graph.nodes.agg(count.alias("nodes"))
    return nodes.withColumn("edges", graph.edges.agg(count).scalar())


#: Rounds along single edges before nodes of one fate are merged, and before shortcuts are made.
PLAIN_ROUNDS = 8
#: Nodes with one way in that are not worth a pass over all edges: left as they are, they cost a round each at most.
FEW_NODES = 8
#: Shortcuts per node and length, where paths fork at every step.
FAN = 4
#: Stands for all nodes that have been reached; no key is empty.
_ORIGIN = ""
_KEY = "a string"


def reachable(
    graph: ProcessGraph, roots: DataFrame | None = None, plain_rounds: int = PLAIN_ROUNDS
) -> DataFrame:
    """Nodes with ``reached``: can they be got to from ``roots`` (default: all source nodes)?

    Each round joins the nodes reached last to the edges, until nothing is new. After some rounds, nodes that share
    their fate are merged (see :func:`_merged`), which takes long paths, trees and ways in both directions at once, and
    the rounds go on between what is left. After as many again, shortcuts of doubling
    length lead from every node that is left to a few of those behind it, so that rounds grow with the
    logarithm of the longest way also where every step forks. A shortcut stands for a way along edges, and the
    rounds still follow every edge, so the answer does not depend on the shortcuts; only their number does.
    """
    if roots is None:
        roots = source_nodes(graph)
    kinds = graph.nodes.select("node", "node_kind")
    start = roots.select("node", "node_kind").distinct().join(kinds, ["node", "node_kind"], "left_semi")
    links = graph.edges.select(_key("src", "src_kind").alias("a"), _key("dst", "dst_kind").alias("b"))
    links = written(links.where("a <> b").distinct(), "links")
    seen = Collected(links.sparkSession, _KEY, "seen")
    new = seen.add(start.select(_key("node", "node_kind").alias("a")))
    new = _rounds(links, seen, new, plain_rounds)
    if not new.isEmpty():
        links, fates = _merged(_left(links, seen.table(), new))
        far = Collected(links.sparkSession, _KEY, "seen")
        new = far.add(links.sparkSession.range(1).select(F.lit(_ORIGIN).alias("a")))
        new = _rounds(links, far, new, plain_rounds)
        if not new.isEmpty():
            links = _left(links, far.table(), new)
            new = far.add(links.sparkSession.range(1).select(F.lit(_ORIGIN).alias("a")))
            _rounds(links.unionByName(_jumps(links)), far, new)
        for fate in reversed(fates):
            far.add(fate.join(far.table().select(F.col("a").alias("p")).distinct(), "p", "left_semi").select("a"))
        seen.add(far.table().where(F.col("a") != _ORIGIN))
    reached = seen.table().select("a", F.lit(True).alias("reached"))
    return kinds.withColumn("a", _key("node", "node_kind")).join(reached, "a", "left").select(
        "node", "node_kind", F.coalesce("reached", F.lit(False)).alias("reached")
    )


def _key(node: str, kind: str) -> Column:
    """Name and kind as one text, different for all pairs; names of a kind keep their order."""
    def part(name, marked):
        return F.when(F.col(name).isNull(), "-").otherwise(marked)

    size = F.length(kind).cast("string")
    return F.concat(part(kind, F.concat(size, F.lit(":"), kind)), part(node, F.concat(F.lit("="), node)))


def _rounds(links: DataFrame, seen: Collected, new: DataFrame, rounds: int | None = None) -> DataFrame:
    """Follow single edges from ``new`` until nothing is new, at most ``rounds`` times; what is new then."""
    done = 0
    while done != rounds and not new.isEmpty():
        onward = links.join(new, "a", "left_semi").select(F.col("b").alias("a")).distinct()
        new = seen.add(onward.join(seen.table(), "a", "left_anti"))
        done += 1
    return new


def _left(links: DataFrame, seen: DataFrame, new: DataFrame) -> DataFrame:
    """The edges to nodes that have not been reached; those from nodes that have (the ``new`` ones) come from the origin."""
    left = links.join(seen.select(F.col("a").alias("b")), "b", "left_anti")
    first = left.join(new, "a", "left_semi").select("b").distinct()  # other edges are as distinct as before
    left = left.join(new, "a", "left_anti").select("a", "b")
    return written(left.unionByName(first.select(F.lit(_ORIGIN).alias("a"), "b")), "links")


def _merged(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``links`` between groups of nodes that are reached together or not at all, and how they were merged.

    A node with one way in is reached if its predecessor is; so is one with a way from the origin. Two nodes with edges
    in both directions are reached together. Each kind of fate points to another node (see :func:`ends_of`), and is
    given as ``a, p``, to be undone last to first; ``p`` is null for nodes that are never reached, behind a closed way that
    nothing enters. Goes on while that takes away a tenth of the edges.
    """
    fates, size, before = [], links.count(), None
    while size and (before is None or 10 * size <= 9 * before):
        before = size
        entered = links.groupBy("b").agg(F.min("a").alias("p"), F.count(F.lit(1)).alias("n"))
        entered = entered.where((F.col("n") == 1) | (F.col("p") == _ORIGIN))
        fate = ends_of(entered.select(F.col("b").alias("a"), "p", F.lit(False).alias("flip")))
        if fate.count() > FEW_NODES:
            fates.append(fate)
            links = links.join(fate.select(F.col("a").alias("b")), "b", "left_anti")
            links = written(_named(links, fate, "a").where("a <> b").distinct(), "links")
        pairs = links.where(F.col("a") != _ORIGIN).groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("a"))
        pairs = pairs.agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        fate = ends_of(pairs.groupBy("a").agg(F.min("p").alias("p")).withColumn("flip", F.lit(False)))
        if not fate.isEmpty():
            fates.append(fate)
            links = _named(_named(links, fate, "a"), fate, "b")
            links = written(links.where("a <> b").distinct(), "links")
        size = links.count()
    return links, fates


def _named(links: DataFrame, fate: DataFrame, end: str) -> DataFrame:
    """``links`` with one end replaced by the node it was merged into, without those of nodes that are never reached."""
    into = fate.select(F.col("a").alias(end), F.col("p").alias("into"), F.lit(True).alias("merged"))
    named = links.join(into, end, "left").where("merged is null or into is not null")
    return named.withColumn(end, F.coalesce("into", end)).select("a", "b")


def _jumps(links: DataFrame, fan: int = FAN) -> DataFrame:
    """``a, b``: up to ``fan`` nodes behind each node, for every length 2, 4, 8, .. of the way to them.

    Which ones is settled by hashes of node, length and target, so a node goes another way at every length
    and closed ways do not hold it. There are ``fan`` rows per node and length at most.
    """
    jumps = Collected(links.sparkSession, links.schema, "jumps")

    def some(ways: DataFrame, level: int) -> DataFrame:
        by_hash = Window.partitionBy("a").orderBy(F.xxhash64("a", "b", F.lit(level)), "b")
        return ways.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= fan).drop("n")

    last = written(some(links, 0), "jumps")
    for level in range(1, links.select("a").distinct().count().bit_length() + 1):
        further = last.select(F.col("a").alias("b"), F.col("b").alias("c"))
        twice = last.join(further, "b").where("a <> c").select("a", F.col("c").alias("b")).distinct()
        last = jumps.add(some(twice, level))
        if last.isEmpty():
            break
    return jumps.table()
