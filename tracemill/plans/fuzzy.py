"""Simplified process graphs: weak nodes go, low-significance nodes gather in clusters, weak
edges between plain nodes are filtered.

``FuzzyBase`` holds what does not depend on the settings. ``FuzzyRun`` answers any number of
settings at once; every table carries ``param_id``. Settings that no value of the log tells apart are
mined once, and pairs are stored once for all settings that differ in the edge cutoff, or in how they
cluster. No step pairs all activities: pairs that never
occur have correlation 0, and their part in the edge filter follows from how many activities
share each of the at most 101 significance values. So do pairs that occur with correlation 0.00, which most pairs of
frequent activities do in a large log: nodes, clusters and edges are found without them.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.rounding import fmt2, mean2, np2
from tracemill.operators.bands import band_cuts, band_of
from tracemill.operators.follows import ProcessModel
from tracemill.operators.graph import ProcessGraph
from tracemill.operators.leaders import clusters
from tracemill.operators.ranking import ranked
from tracemill.plans.params import FuzzyParams, param_rows
from tracemill.storage import written

# Sizes of nodes and edges.
NODE_WIDTH = 1.5
CLUSTER_WIDTH = 1.5
CLUSTER_HEIGHT = 1.0
EDGE_WIDTH = 0.1

#: Activities with at least one in so many of all steps are known to every task; there are no more of them than that.
FREQUENT = 200_000
#: Activities whose totals every task may hold, and the bytes of a label among them.
KNOWN, LABEL_BYTES = 200_000, 256

_SETTINGS = ("significance", "correlation", "edge_cutoff", "utility_ratio")
_REMOVED = "(only_node or ({0}sig < significance and {0}strongest < correlation))"


def outgoing(model: ProcessModel) -> DataFrame:
    """``src, total``: steps that leave an activity, self-loops counted."""
    if model.totals is not None:
        return model.totals
    return model.dfg.groupBy("src").agg(F.sum("cnt").alias("total"))


def correlation(model: ProcessModel) -> DataFrame:
    """``src, dst, cnt, corr``: the share of a pair in what leaves ``src``.

    Pairs of frequent sources, most of a large log's, stay where they are read; only the others are shuffled to their totals.
    """
    totals = outgoing(model)
    known = F.broadcast(_frequent(totals).withColumnRenamed("total", "known"))
    near = model.dfg.join(known, "src").withColumnRenamed("known", "total")
    far = model.dfg.join(known, "src", "left").where("known is null").drop("known").join(_hashed(totals), "src")
    return near.unionByName(far).select("src", "dst", "cnt", fmt2(F.col("cnt") / F.col("total")).alias("corr"))


def _frequent(totals: DataFrame) -> DataFrame:
    """The activities of ``totals`` with the largest ones, down to a power of two: as many as every task may know."""
    short = totals.where(F.octet_length("src") <= LABEL_BYTES)
    size = F.floor(F.log2("total")).alias("size")
    sizes = short.groupBy(size).agg(F.count(F.lit(1)).alias("n"))  # 63 rows at most
    upto = F.sum("n").over(Window.orderBy(F.desc("size")))
    least = sizes.select("size", upto.alias("n")).where(F.col("n") <= KNOWN).agg(F.coalesce(F.min("size"), F.lit(63)))
    return short.where(size >= least.scalar())


def _hashed(table: DataFrame) -> DataFrame:
    """``table`` as the side of a join that is held, by partition, as a hash table, so that pairs are not sorted for the
    join. Only for tables with a row per activity (and setting): their keys differ, so they come apart evenly."""
    return table.hint("shuffle_hash")


def significance(model: ProcessModel) -> DataFrame:
    """``activity, freq, sig``: frequency relative to the most frequent activity."""
    top = model.activities.agg(F.max("freq"))
    return model.activities.select("activity", "freq", fmt2(F.col("freq") / top.scalar()).alias("sig"))


class FuzzyBase:
    """``nodes(activity, freq, sig, strongest, only_node)``, ``links`` between different
    activities with the ``sig`` and ``strongest`` of both ends, and ``felt``, those with a correlation above 0.

    ``strongest`` is the largest correlation on any edge of the node. A node is removed exactly
    when it is below the significance and its strongest edge is below the correlation, so one
    number per node decides the first rule for all settings.
    """

    def __init__(self, model: ProcessModel):
        self.model = model

    @cached_property
    def pairs(self) -> DataFrame:
        """``src, dst, cnt, corr`` of different activities."""
        return written(correlation(self.model).where("src <> dst"), "correlation")

    @cached_property
    def activities(self) -> DataFrame:
        """``activity, freq, sig, total``: every event but the last of a case is followed by one, so ``total`` leave it."""
        total = F.col("freq") - F.coalesce("cases", F.lit(0))
        table = significance(self.model).join(self.model.ends, "activity", "left")
        return written(table.select("activity", "freq", "sig", total.alias("total")), "activities")

    @cached_property
    def felt(self) -> DataFrame:
        """``src, dst, cnt, corr, src_sig`` of different activities whose correlation is not 0.

        Pairs of frequent activities that come to 0 are dropped where they are read, so they are not shuffled.
        """
        sources = self.activities.where("total > 0").select(F.col("activity").alias("src"), "total", F.col("sig").alias("src_sig"))
        steps = sources.agg(F.sum("total")).first()[0] or 0
        frequent = sources.where(F.col("total") * FREQUENT >= F.lit(steps)).select("src", F.col("total").alias("known"))
        pairs = self.model.dfg.where("src <> dst").join(F.broadcast(frequent), "src", "left")
        pairs = pairs.where(F.col("known").isNull() | (fmt2(F.col("cnt") / F.col("known")) > 0)).drop("known")
        corr = fmt2(F.col("cnt") / F.col("total")).alias("corr")
        felt = pairs.join(_hashed(sources), "src").select("src", "dst", "cnt", corr, "src_sig")
        return written(felt.where("corr > 0"), "felt")

    @cached_property
    def nodes(self) -> DataFrame:
        strongest = (
            self.felt.select(F.explode(F.array("src", "dst")).alias("activity"), "corr")
            .groupBy("activity")
            .agg(F.max("corr").alias("strongest"))
        )
        size = self.activities.agg(F.count(F.lit(1)))
        return written(
            self.activities.drop("total")
            .join(strongest, "activity", "left")
            .withColumn("strongest", F.coalesce("strongest", F.lit(0.0)))
            .withColumn("only_node", size.scalar() == 1),
            "fuzzy-nodes",
        )

    @cached_property
    def links(self) -> DataFrame:
        ends = {
            side: self.nodes.select(
                F.col("activity").alias(side),
                F.col("sig").alias(f"{side}_sig"),
                F.col("strongest").alias(f"{side}_strongest"),
            )
            for side in ("src", "dst")
        }
        return self.pairs.join(ends["src"], "src").join(ends["dst"], "dst")


def _expanded(table: DataFrame, members: list[list[int]]) -> DataFrame:
    """``table`` with a copy of the rows of class ``param_id`` for each of its members."""
    if all(m == [i] for i, m in enumerate(members)):
        return table
    ids = ", ".join(f"array({', '.join(f'{i}L' for i in m)})" for m in members)
    return table.withColumn("param_id", F.expr(f"explode(array({ids})[cast(param_id as int)])"))


def _classes(keys: Sequence[Hashable]) -> list[list[int]]:
    """The places of equal keys, in the order of their first ones."""
    places: dict[Hashable, list[int]] = {}
    for i, key in enumerate(keys):
        places.setdefault(key, []).append(i)
    return list(places.values())


class _Nodes:
    """The nodes that go, stay, and begin clusters, under each setting."""

    def __init__(self, base: FuzzyBase, params: Sequence[FuzzyParams]):
        self.base = base
        self.params = list(params)
        self._rows = param_rows(self.params)

    @cached_property
    def _all_nodes(self) -> DataFrame:
        per_param = self.base.nodes.select("*", F.inline(self._rows))
        return per_param.withColumn("removed", F.expr(_REMOVED.format("")))

    @property
    def removed(self) -> DataFrame:
        """``param_id, activity``"""
        return self._all_nodes.where("removed").select("param_id", "activity")

    @property
    def live(self) -> DataFrame:
        """``param_id, activity, freq, sig`` of the nodes that stay."""
        return self._all_nodes.where("not removed").select("param_id", "activity", "freq", "sig")

    @property
    def seeds(self) -> DataFrame:
        """``param_id, activity`` of the nodes that stay but are below the significance."""
        return self._all_nodes.where("not removed and sig < significance").select(
            "param_id", "activity"
        )


class _Links(_Nodes):
    """Pairs between live nodes and their utility, before the edge cutoff."""

    def __init__(self, base: FuzzyBase, params: Sequence[FuzzyParams], felt: bool = False):
        super().__init__(base, params)
        self._only_felt = felt

    @cached_property
    def _felt_links(self) -> DataFrame:
        """Pairs that are felt, with what decides on their ends where a setting may remove them."""
        below = f"sig < {max(float(p.significance) for p in self.params)!r}D"
        weak = self.base.nodes.where(f"{below} and strongest < {max(float(p.correlation) for p in self.params)!r}D")
        weak = written(weak.select("activity", "sig", "strongest"), "weak")
        src = weak.select(F.col("activity").alias("src"), F.col("strongest").alias("src_strongest"))
        dst = weak.select(
            F.col("activity").alias("dst"), F.col("sig").alias("dst_sig"), F.col("strongest").alias("dst_strongest")
        )
        return self.base.felt.join(src, "src", "left").join(dst, "dst", "left")

    @property
    def _live_links(self) -> DataFrame:
        ends = [_REMOVED.format(f"{side}_").replace("only_node", "false") for side in ("src", "dst")]
        links = self._felt_links if self._only_felt else self.base.links
        return links.select("*", F.inline(self._rows)).where(
            f"not coalesce({ends[0]}, false) and not coalesce({ends[1]}, false)"
        )

    @property
    def utility(self) -> DataFrame:
        """``param_id, src, dst, .., util`` of the pairs that occur between live nodes."""
        u = F.col("utility_ratio")
        util = np2(F.col("src_sig") * u + (F.lit(1.0) - u) * F.col("corr"))
        off = F.expr("utility_ratio = 0 and edge_cutoff = 0")
        return self._live_links.withColumn("util", F.when(off, 0.0).otherwise(util))

    @property
    def utility_bounds(self) -> DataFrame:
        """``param_id, dst, max_util, min_util`` over all live sources of a target.

        ``min_util`` is the smallest value other than 0, null when there is none. A source that
        never precedes the target has the utility of its significance alone. So for the pairs
        that do not occur it is enough to know which of those values are left over when the
        sources that do occur, and the target itself, are taken out of the counts per value. A pair that
        occurs with correlation 0 has that utility as well, so it may be left out.
        """
        alone = "rint({0} * utility_ratio * 100D) / 100D as alone"
        live = self._all_nodes.where("not removed").selectExpr(
            "param_id", "activity as dst", alone.format("sig")
        )
        # Both collections have one entry per value: at most 101.
        everyone = (
            live.groupBy("param_id", "alone")
            .agg(F.expr("count(1) as n"))
            .groupBy("param_id")
            .agg(F.expr("map_from_entries(collect_list(struct(alone, n))) as everyone"))
        )
        occurring = self.utility.selectExpr("param_id", "dst", alone.format("src_sig"), "util")
        seen = (
            occurring.unionByName(live.selectExpr("*", "cast(null as double) as util"))
            .groupBy("param_id", "dst", "alone")
            .agg(
                F.expr("count(1) as n"),
                F.expr("max(util) as max_util"),
                F.expr("min(nullif(util, 0D)) as min_util"),
            )
            .groupBy("param_id", "dst")
            .agg(
                F.expr("collect_list(struct(alone, n)) as seen"),
                F.expr("max(max_util) as max_seen"),
                F.expr("min(min_util) as min_seen"),
            )
        )
        used_up = "transform(filter(seen, s -> s.n >= everyone[s.alone]), s -> s.alone)"
        return (
            # One row per setting.
            seen.join(F.broadcast(everyone), "param_id")
            .selectExpr("*", f"array_except(map_keys(everyone), {used_up}) as unseen")
            .selectExpr(
                "param_id",
                "dst",
                "greatest(max_seen, array_max(unseen), 0D) as max_util",
                "least(min_seen, array_min(array_remove(unseen, 0D))) as min_util",
            )
        )

    @cached_property
    def scaled(self) -> DataFrame:
        """``param_id, src, dst, cnt, corr, util, scaled``: the place of ``util`` in its target's bounds."""
        columns = ("param_id", "src", "dst", "cnt", "corr")
        if not any(p.filters_edges for p in self.params):
            none = F.lit(None).cast("double").alias("scaled")
            return written(self._live_links.select(*columns, F.lit(0.0).alias("util"), none), "links")
        above = F.col("util") - F.col("min_util")
        span = F.col("max_util") - F.col("min_util")
        scaled = F.when((above != 0) & (span != 0), np2(above / span))
        return written(
            self.utility.join(_hashed(self.utility_bounds), ["param_id", "dst"]).select(
                *columns, "util", scaled.alias("scaled")
            ),
            "links",
        )


class _Mined(_Nodes):
    """All tables for settings that differ in their outcome; ``of_links`` has the settings of each class of links."""

    def __init__(
        self, base: FuzzyBase, params: Sequence[FuzzyParams], links: _Links, felt: _Links, of_links: list[list[int]]
    ):
        super().__init__(base, params)
        self._links, self._felt, self._of_links = links, felt, of_links

    @property
    def links(self) -> DataFrame:
        """``param_id, src, dst, cnt, corr, util, norm`` and settings, of the pairs between live nodes."""
        return self._normalised(self._links)

    @property
    def felt(self) -> DataFrame:
        """``links`` with a correlation above 0."""
        return self._normalised(self._felt)

    def _normalised(self, links: _Links) -> DataFrame:
        scaled, cutoff = F.col("scaled"), F.col("edge_cutoff")
        keeps = (scaled >= cutoff) & (scaled > 0) & (F.col("corr") > 0)
        keeps = keeps & ~F.expr("utility_ratio = 0 and edge_cutoff = 0")
        each = _expanded(links.scaled, self._of_links)
        settings = self._rows[F.col("param_id").cast("int")]
        return each.select("*", *(settings[name].alias(name) for name in _SETTINGS)).withColumn(
            "norm", F.when(keeps, scaled).otherwise(0.0)
        )

    @property
    def normalised(self) -> DataFrame:
        """``param_id, src, dst, util, norm``"""
        return self.links.select("param_id", "src", "dst", "util", "norm")

    @cached_property
    def _marked_links(self) -> DataFrame:
        active = self.felt.where("norm > 0").select("param_id").distinct()
        # One row per setting.
        active = F.broadcast(active.withColumn("active", F.lit(True)))
        return self.felt.join(active, "param_id", "left").withColumn(
            "filtered", F.expr("norm = 0 and coalesce(active, false)")
        )

    @property
    def filtered(self) -> DataFrame:
        """``param_id, src, dst`` that the filter takes out of the edges between plain nodes."""
        return self._marked_links.where("filtered").select("param_id", "src", "dst")

    # -- clusters ------------------------------------------------------------

    @cached_property
    def clusters(self) -> DataFrame:
        """``param_id, activity, leader`` of the clustered nodes."""
        some = [i for i, p in enumerate(self.params) if p.correlation > 0]
        parts = []
        if some:
            strong = self.felt.where("correlation > 0 and corr >= correlation").select(
                "param_id", F.col("src").alias("a"), F.col("dst").alias("b")
            )
            seeds = self.seeds.where(F.col("param_id").isin(some))
            parts.append(clusters(seeds, strong))
        if len(some) < len(self.params):
            # With correlation 0 all live nodes are linked: the first seed claims them.
            first = self.seeds.where(~F.col("param_id").isin(some)).groupBy("param_id").agg(
                F.min("activity").alias("leader")
            )
            parts.append(
                self.live.join(F.broadcast(first), "param_id").select("param_id", "activity", "leader")
            )
        table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return written(table, "clusters")

    @cached_property
    def _cluster_means(self) -> DataFrame:
        """``param_id, leader, size, sig``"""
        members = self.clusters.join(self.live, ["param_id", "activity"])
        return mean2(members, ["param_id", "leader"], "sig", fmt2, "sig")

    @cached_property
    def cluster_nodes(self) -> DataFrame:
        """``param_id, leader, number, size, sig``; numbered from 1 in the order of leaders."""
        return ranked(self._cluster_means, ["leader"], "number", keys=["param_id"])

    @cached_property
    def cluster_names(self) -> DataFrame:
        """``param_id, leader, position, activity``: the members in label order, from 1."""
        return ranked(self.clusters, ["activity"], "position", keys=["param_id", "leader"])

    @property
    def node_significance(self) -> DataFrame:
        """``param_id, activity, sig, removed`` after clustering, for every activity."""
        final = self.clusters.join(
            self._cluster_means.select("param_id", "leader", F.col("sig").alias("cluster_sig")),
            ["param_id", "leader"],
        )
        return self._all_nodes.join(final, ["param_id", "activity"], "left").select(
            "param_id",
            "activity",
            F.when(~F.col("removed"), F.coalesce("cluster_sig", "sig")).alias("sig"),
            "removed",
        )

    # -- graph ---------------------------------------------------------------

    @property
    def _ends(self) -> DataFrame:
        ends = {
            side: self.clusters.select(
                "param_id", F.col("activity").alias(side), F.col("leader").alias(f"{side}_leader")
            )
            for side in ("src", "dst")
        }
        mapped = self._marked_links.join(_hashed(ends["src"]), ["param_id", "src"], "left").join(
            _hashed(ends["dst"]), ["param_id", "dst"], "left"
        )
        columns = ["param_id", "corr", "filtered"]
        for side in ("src", "dst"):
            columns.append(f"coalesce({side}_leader, {side}) as {side}_end")
            columns.append(f"if({side}_leader is null, 'activity', 'cluster') as {side}_kind")
        inside = "src_kind = 'cluster' and dst_kind = 'cluster' and src_end = dst_end"
        return mapped.selectExpr(*columns).where(f"not ({inside})")

    @property
    def edges(self) -> DataFrame:
        """``param_id, src, src_kind, dst, dst_kind, value, links``; a cluster goes by its leader.

        Edges at a cluster carry the mean correlation of the links they stand for; the edge
        filter acts on edges between plain nodes only, each of which is a group of its own.
        """
        plain = "src_kind = 'activity' and dst_kind = 'activity'"
        keys = ["param_id", "src_end", "src_kind", "dst_end", "dst_kind"]
        return mean2(self._ends.where(f"not ({plain} and filtered)"), keys, "corr", np2, "value").select(
            "param_id",
            F.col("src_end").alias("src"),
            "src_kind",
            F.col("dst_end").alias("dst"),
            "dst_kind",
            "value",
            F.col("size").alias("links"),
        )

    @property
    def plain_nodes(self) -> DataFrame:
        """``param_id, activity, freq, sig`` of live nodes in no cluster."""
        return self.live.join(self.clusters, ["param_id", "activity"], "left_anti")

    def graph_nodes(self, sizes: bool) -> DataFrame:
        plain = self.plain_nodes.select(
            "param_id",
            F.col("activity").alias("node"),
            F.lit("activity").alias("node_kind"),
            "sig",
            "freq",
            F.lit(1).cast("long").alias("size"),
        )
        grouped = self.cluster_nodes.select(
            "param_id",
            F.col("leader").alias("node"),
            F.lit("cluster").alias("node_kind"),
            "sig",
            "size",
            "number",
        )
        if sizes:
            width = band_of("freq", band_cuts(self.base.nodes, "freq")) / 2 + NODE_WIDTH
            plain = plain.withColumns({"width": width, "height": width / 3})
            grouped = grouped.withColumns(
                {"width": F.lit(CLUSTER_WIDTH), "height": F.lit(CLUSTER_HEIGHT)}
            )
        return plain.unionByName(grouped, allowMissingColumns=True)

    def graph_edges(self, sizes: bool) -> DataFrame:
        return self.edges.withColumn("penwidth", F.lit(EDGE_WIDTH)) if sizes else self.edges


class FuzzyRun:
    """All tables of the miner for a list of settings.

    What a setting does follows from which nodes go, which begin clusters, and which correlations reach its
    threshold. These values have two decimals, so at most 10,201 pairs of them (one row each) tell all settings
    apart; settings with one outcome are mined and stored once, and their rows are copied only in the output.
    """

    def __init__(self, base: FuzzyBase, params: Sequence[FuzzyParams]):
        if not params:
            raise ValueError("no settings given")
        self.base = base
        self.params = list(params)

    @cached_property
    def _keys(self) -> list[tuple[Hashable, Hashable]]:
        """Per setting, what its links depend on, and what else its outcome depends on."""
        if len(self.params) == 1:
            return [(0, 0)]
        values = self.base.nodes.select("sig", "strongest", "only_node").distinct().collect()
        shares = [c for (c,) in self.base.felt.select("corr").distinct().collect()]
        keys = []
        for p in self.params:
            low = [sig < p.significance for sig, _, _ in values]
            gone = bytes(
                only or (below and strongest < p.correlation)
                for (_, strongest, only), below in zip(values, low, strict=True)
            )
            links = (gone, p.utility_ratio, p.filters_edges)
            seeds = bytes(below and not out for below, out in zip(low, gone, strict=True))
            weak = sum(c < p.correlation for c in shares)
            keys.append((links, (seeds, p.edge_cutoff, p.correlation == 0, weak)))
        return keys

    @cached_property
    def _members(self) -> list[list[int]]:
        """The settings of each outcome."""
        return _classes(self._keys)

    @cached_property
    def _link_members(self) -> list[list[int]]:
        """The settings of each class of links."""
        return _classes([links for links, _ in self._keys])

    @cached_property
    def _links(self) -> _Links:
        return _Links(self.base, [self.params[m[0]] for m in self._link_members])

    @cached_property
    def _felt(self) -> _Links:
        return _Links(self.base, self._links.params, felt=True)

    @cached_property
    def _mined(self) -> _Mined:
        first = [m[0] for m in self._members]
        of_links = _classes([self._keys[i][0] for i in first])
        return _Mined(self.base, [self.params[i] for i in first], self._links, self._felt, of_links)

    def _all(self, table: DataFrame) -> DataFrame:
        return _expanded(table, self._members)

    @property
    def removed(self) -> DataFrame:
        """``param_id, activity``"""
        return self._all(self._mined.removed)

    @property
    def live(self) -> DataFrame:
        """``param_id, activity, freq, sig`` of the nodes that stay."""
        return self._all(self._mined.live)

    @property
    def seeds(self) -> DataFrame:
        """``param_id, activity`` of the nodes that stay but are below the significance."""
        return self._all(self._mined.seeds)

    @property
    def utility(self) -> DataFrame:
        """``param_id, src, dst, cnt, corr, util`` of the pairs that occur between live nodes."""
        utility = self._links.utility.select("param_id", "src", "dst", "cnt", "corr", "util")
        return _expanded(utility, self._link_members)

    @property
    def utility_bounds(self) -> DataFrame:
        """``param_id, dst, max_util, min_util`` over all live sources of a target."""
        return _expanded(self._links.utility_bounds, self._link_members)

    @property
    def links(self) -> DataFrame:
        """``param_id, src, dst, cnt, corr, util, norm`` of the pairs between live nodes."""
        return self._all(self._mined.links.select("param_id", "src", "dst", "cnt", "corr", "util", "norm"))

    @property
    def normalised(self) -> DataFrame:
        """``param_id, src, dst, util, norm``"""
        return self._all(self._mined.normalised)

    @property
    def filtered(self) -> DataFrame:
        """``param_id, src, dst`` that the filter takes out of the edges between plain nodes."""
        return self._all(self._mined.filtered)

    @property
    def clusters(self) -> DataFrame:
        """``param_id, activity, leader`` of the clustered nodes."""
        return self._all(self._mined.clusters)

    @property
    def cluster_nodes(self) -> DataFrame:
        """``param_id, leader, number, size, sig``; numbered from 1 in the order of leaders."""
        return self._all(self._mined.cluster_nodes)

    @property
    def cluster_names(self) -> DataFrame:
        """``param_id, leader, position, activity``: the members in label order, from 1."""
        return self._all(self._mined.cluster_names)

    @property
    def node_significance(self) -> DataFrame:
        """``param_id, activity, sig, removed`` after clustering, for every activity."""
        return self._all(self._mined.node_significance)

    @property
    def edges(self) -> DataFrame:
        """``param_id, src, src_kind, dst, dst_kind, value, links``; a cluster goes by its leader."""
        return self._all(self._mined.edges)

    @property
    def plain_nodes(self) -> DataFrame:
        """``param_id, activity, freq, sig`` of live nodes in no cluster."""
        return self._all(self._mined.plain_nodes)

    def graph(self, sizes: bool = True) -> ProcessGraph:
        """Nodes and edges of every setting; ``sizes=False`` leaves out the banded sizes.

        Nothing runs before the nodes or the edges are asked for, and each is found without the other.
        """
        return ProcessGraph(
            lambda: self._all(self._mined.graph_nodes(sizes)), lambda: self._all(self._mined.graph_edges(sizes))
        )


def fuzzy_graph(
    model: ProcessModel,
    significance: float = 0.0,
    correlation: float = 0.0,
    edge_cutoff: float = 0.0,
    utility_ratio: float = 0.0,
    sizes: bool = True,
) -> ProcessGraph:
    """The graph of one setting, which the model remembers."""
    params = FuzzyParams(significance, correlation, edge_cutoff, utility_ratio)
    graph = FuzzyRun(FuzzyBase(model), [params]).graph(sizes)
    model.miner, model.params = "fuzzy", {name: float(getattr(params, name)) for name in _SETTINGS}
    return ProcessGraph(lambda: graph.nodes.drop("param_id"), lambda: graph.edges.drop("param_id"))
