"""Connected components by alternating stars, in rounds over stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.storage import written


def _closest(pairs: DataFrame) -> DataFrame:
    """Per ``u`` the smallest ``v``, summed up before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``): the smallest node reachable from each node of ``edges`` (``a``, ``b``).

    Every round joins each edge to the smallest neighbour of its end, first over larger neighbours,
    then over smaller ones, until the edges are stars around their smallest node; the number of rounds
    grows with the logarithm of a component's size. No group is gathered: a node with a third of all
    edges is a join key that adaptive execution may split.

    Edges with a null end, loops and repeated edges change nothing; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = written(pairs.where("u > v").distinct(), "stars")
    before = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _closest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "stars")
        least = _closest(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
