"""Clusters around leaders: the greedy grouping of low-significance activities.

Going through the seeds in label order, a seed that no earlier leader is linked to becomes a
leader; it claims every node linked to it that is still free. So the leaders are the
lexicographically first maximal independent set of the seeds, and every other node belongs to
the smallest leader it is linked to.

The set is found in rounds over *conditions*: a seed leads when each smaller seed linked to it does not. A
condition whose seed is decided is met, and goes, or decides against its owner; a seed without conditions leads.
A seed with one condition left is a function of one other seed, equal to it or its opposite. Such functions are
composed as pointers that are followed to their ends (see :mod:`forest`), so that a chain of any length takes few
rounds, and they take the place of their seeds in all other conditions. So the rounds are as many as the longest wait among seeds that
wait for several others at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.forest import ends_of
from tracemill.storage import Collected, written

_DECIDED = "param_id {0}, activity string, leads boolean"
_FUNCTION = "param_id {0}, activity string, root string, opposite boolean"


def leaders(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Leaders among ``seeds(param_id, activity)`` under ``links(param_id, a, b)``.

    Links are taken in both directions; ends that are not seeds are ignored.
    """
    open_seeds = written(seeds.select("param_id", "activity").distinct(), "open-seeds")
    smaller, larger = _as(open_seeds, "a"), _as(open_seeds, "b")
    pairs = (
        links.where("a <> b")
        .select("param_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(smaller, ["param_id", "a"], "left_semi")
        .join(larger, ["param_id", "b"], "left_semi")
    )
    # ``activity`` leads only if ``other`` does as ``must`` says
    conditions = pairs.select(
        "param_id", F.col("b").alias("activity"), F.col("a").alias("other"), F.lit(False).alias("must")
    )
    conditions = written(conditions, "conditions")
    spark, kind = seeds.sparkSession, open_seeds.schema["param_id"].dataType.simpleString()
    decided = Collected(spark, _DECIDED.format(kind), "decided")
    functions = Collected(spark, _FUNCTION.format(kind), "functions")
    free = open_seeds.join(conditions, ["param_id", "activity"], "left_anti")
    new, some_functions, waiting = decided.add(free.withColumn("leads", F.lit(True))), False, True
    while waiting:
        state = written(_state(conditions, new), "seed-states")
        counts = {r["kind"]: r["count"] for r in state.groupBy("kind").count().collect()}  # three kinds at most
        before, new = new, decided.add(state.where("kind = 'decided'").select("param_id", "activity", "leads"))
        jumps = None
        if "function" in counts:
            jumps = functions.add(_composed(state.where("kind = 'function'").select(
                "param_id", "activity", F.col("low.other").alias("root"), (~F.col("low.must")).alias("opposite")
            )))
            some_functions = True
        waiting = "waiting" in counts
        if waiting:
            conditions = written(_reduced(conditions, state, before, jumps), "conditions")
    lead = decided.table()
    if some_functions:
        ends = functions.table() if len(functions.parts) == 1 else _composed(functions.table())
        ends = ends.withColumnRenamed("activity", "own")
        roots = lead.withColumnRenamed("activity", "root")
        found = ends.join(roots, ["param_id", "root"]).select(
            "param_id", F.col("own").alias("activity"), (F.col("leads") != F.col("opposite")).alias("leads")
        )
        lead = lead.unionByName(found)
    return lead.where("leads").select("param_id", "activity")


def _state(conditions: DataFrame, new: DataFrame) -> DataFrame:
    """Per seed with conditions whether it is decided, a function of another one, or waiting, given what is ``new``."""
    known = new.select("param_id", F.col("activity").alias("other"), "leads")
    met = conditions.join(known, ["param_id", "other"], "left")
    still = F.when(F.col("leads").isNull(), F.struct("other", "must"))
    per_seed = met.groupBy("param_id", "activity").agg(
        F.coalesce(F.bool_or(F.col("leads") != F.col("must")), F.lit(False)).alias("broken"),
        F.min(still).alias("low"),
        F.max(still).alias("high"),
    )
    both = (F.col("low.other") == F.col("high.other")) & (F.col("low.must") != F.col("high.must"))
    over = F.col("broken") | F.col("low").isNull() | both
    kind = F.when(over, "decided").when(F.col("low") == F.col("high"), "function").otherwise("waiting")
    leads = ~F.col("broken") & F.col("low").isNull()
    return per_seed.select("param_id", "activity", kind.alias("kind"), leads.alias("leads"), "low")


def _composed(functions: DataFrame) -> DataFrame:
    """``functions`` (``activity``, ``root``, ``opposite``) with roots that are no functions themselves.

    Roots are smaller than their seeds, so there are no circles. A setting and a seed are one name for :func:`ends_of`.
    """
    kind = functions.schema["param_id"].dataType

    def name(seed: str) -> Column:
        return F.concat(F.col("param_id").cast("string"), F.lit(" "), F.col(seed))

    ends = ends_of(functions.select(name("activity").alias("a"), name("root").alias("p"), F.col("opposite").alias("flip")))
    return ends.select(
        F.substring_index("a", " ", 1).cast(kind).alias("param_id"),
        F.expr("substring(a, instr(a, ' ') + 1)").alias("activity"),
        F.expr("substring(p, instr(p, ' ') + 1)").alias("root"),
        F.col("flip").alias("opposite"),
    )


def _reduced(
    conditions: DataFrame, state: DataFrame, known: DataFrame, functions: DataFrame | None
) -> DataFrame:
    """The conditions of seeds that wait, without those that are met, about the roots of functions."""
    waiting = state.where("kind = 'waiting'").select("param_id", "activity")
    left = conditions.join(waiting, ["param_id", "activity"], "left_semi").join(
        known.select("param_id", F.col("activity").alias("other")), ["param_id", "other"], "left_anti"
    )
    if functions is None:
        return left
    functions = functions.withColumnRenamed("activity", "other")
    must = F.col("must") != F.coalesce("opposite", F.lit(False))
    left = left.join(functions, ["param_id", "other"], "left").select(
        "param_id", "activity", F.coalesce("root", "other").alias("other"), must.alias("must")
    )
    return left.distinct()


def _as(seeds: DataFrame, end: str) -> DataFrame:
    return seeds.select("param_id", F.col("activity").alias(end))


def clusters(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Members of clusters: ``param_id, activity, leader``, each activity at most once."""
    lead = written(leaders(seeds, links), "leaders")
    ends = links.selectExpr(
        "param_id", "inline(array(struct(a as leader, b as activity), struct(b as leader, a as activity)))"
    )
    claimed = (
        ends.join(lead.withColumnRenamed("activity", "leader"), ["param_id", "leader"])
        .groupBy("param_id", "activity")
        .agg(F.min("leader").alias("leader"))
    )
    return lead.withColumn("leader", F.col("activity")).unionByName(claimed)
