"""Where pointers lead in the end: every node has one, and follows it to a node that has none.

Nodes are dealt to tasks by ranges of their names, and each task follows its own pointers as far as they stay there, as
one array. What is left points into another task; only nodes that are pointed to from there take part in the next level,
so that a long way along neighbouring names ends after two or three levels. Where names do not follow the ways, so that
most nodes are pointed to from elsewhere, the rest is followed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.storage import written

_POINTERS = "a string, p string, flip boolean"
#: Nodes that a task follows on its own.
TASK_ROWS = 250_000


def ends_of(pointers: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``a, p, flip`` with ``p`` the last node on the way from ``a``, and whether an odd number of flips lie on it.

    ``pointers`` has the same columns, each ``a`` once. A node that leads into a closed way has no end: ``p`` is null.
    """
    level = written(pointers.select("a", "p", "flip"), "pointers")
    rows, levels, beyond = level.count(), [], None
    while rows:
        dealt = level.repartitionByRange(-(-rows // task_rows), "a")
        levels.append(written(dealt.mapInPandas(_followed(), _POINTERS), "pointers"))
        if rows <= task_rows:
            break
        level = levels[-1].join(levels[-1].select(F.col("p").alias("a")).distinct(), "a", "left_semi")
        level = written(level, "pointers")
        before, rows = rows, level.count()
        if 2 * rows > before:
            beyond = _doubled(level, rows)
            break
    if not levels:
        return level
    while levels:
        own = levels.pop()
        beyond = own if beyond is None else written(_onward(own, beyond).drop("more"), "pointers")
    return beyond


def _onward(pointers: DataFrame, others: DataFrame) -> DataFrame:
    """``pointers`` moved on along ``others``; ``more`` where there was a way on."""
    others = others.select(F.col("a").alias("p"), F.col("p").alias("end"), F.col("flip").alias("turned"))
    more = F.col("turned").isNotNull()
    return pointers.join(others, "p", "left").select(
        "a", F.when(more, F.col("end")).otherwise(F.col("p")).alias("p"),
        (F.col("flip") != F.coalesce("turned", F.lit(False))).alias("flip"), more.alias("more"),
    )


def _doubled(pointers: DataFrame, rows: int) -> DataFrame:
    """The ends by doubling the ways of all nodes at once."""
    for _ in range(rows.bit_length() + 1):
        moved = written(_onward(pointers, pointers), "pointers")
        pointers = moved.drop("more")
        if moved.where("more and p is not null").isEmpty():
            return pointers
    closed = F.col("more") & F.col("p").isNotNull()  # a way as long as there are nodes, and still no end
    return moved.select("a", F.when(~closed, F.col("p")).alias("p"), "flip")


def _followed():
    """The function that follows the pointers of one task while they stay in it; made here, it needs no import elsewhere."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        batches = list(batches)
        if not batches:
            return
        rows = pd.concat(batches, ignore_index=True)
        target, flip = rows["p"].to_numpy(dtype=object), rows["flip"].to_numpy().astype(bool)
        at = pd.Index(rows["a"]).get_indexer(target)
        here = np.arange(len(rows))
        to, turned = np.where(at < 0, here, at), np.where(at < 0, False, flip)
        for _ in range(len(rows).bit_length() + 1):
            turned, last, to = turned ^ turned[to], to, to[to]
            if (last == to).all():
                break
        end = np.where(at[to] < 0, target[to], None)  # else the way is closed
        yield pd.DataFrame({"a": rows["a"], "p": end, "flip": turned ^ flip[to]})

    return run
