"""Mixing sources to target weights with a hypergeometric splitting tree (operator 10).

Every source is a stream of words: its documents in a fixed pseudo-random order, again from the start
when the target exceeds the source. The stream up to the target is cut into equal blocks, so that a
source has an exact quota of blocks. A binary tree splits the quotas of all sources among the output
shards: at each node, how many of a source's blocks go left is drawn from the hypergeometric
distribution given what earlier sources took, which makes the whole vector multivariate hypergeometric.
The blocks of a source are permuted and dealt to the leaves in turn, hence disjoint, and each shard is
shuffled on its own.

All of it is DataFrame functions; draws are hashes of the seed and their place, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, with_row
from tracemill.llm.prefix import running_totals
from tracemill.storage import written

#: No document is used more often.
MAX_REPEATS = 3
#: Blocks per output shard, all sources together.
SHARD_BLOCKS = 64
#: The weights of sources in code point order, over and over.
WEIGHTS = (1, 2, 3)


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(``source``, ``source_size``, ``weight``, ``target``) from rows of (``source``, ``size``).

    Targets share the total size by weight; none exceeds :data:`MAX_REPEATS` times its source, and what is
    cut off is shared again by weight. In the order of limit over weight the cut sources come first, so
    the level of the others follows from running sums over the sources, without rounds.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(by_source) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(number, F.lit(len(weights))).cast("int"))
    limit = F.col("source_size") * MAX_REPEATS
    ranked = per_source.withColumn("weight", weight).withColumn("limit", limit)
    line = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, rest = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(rest))
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level")))
    level = open_level.over(everything)["level"]
    return levels.withColumn("fill", level).select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("limit").cast("double"), F.coalesce(F.col("fill"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def _log_factorial(n: Column) -> Column:
    """ln n!, exactly tabulated up to 20, by Stirling's series beyond (error under 1e-10)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(x * 6.283185307179586) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(
        series + 1 / (1260 * F.pow(x, F.lit(5)))
    )


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _drawn(all_blocks: Column, own: Column, wanted: Column, u: Column) -> Column:
    """How many of ``wanted`` blocks out of ``all_blocks`` are among ``own``: inversion at ``u``."""
    least = F.greatest(F.lit(0), wanted - (all_blocks - own))
    most = F.least(own, wanted)
    scale = _log_choose(all_blocks, wanted)

    def step(state: Column, k: Column) -> Column:
        chance = F.exp(_log_choose(own, k) + _log_choose(all_blocks - own, wanted - k) - scale)
        return F.struct(
            (state["sum"] + chance).alias("sum"),
            F.when(state["sum"] <= u, k).otherwise(state["k"]).alias("k"),
        )

    start = F.struct(F.lit(0.0).alias("sum"), least.alias("k"))
    return F.aggregate(F.sequence(least, most), start, step)["k"]


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(``number``, ``shard``, ``before``, ``blocks``) from (``number``, ``blocks``) per source.

    ``before`` is how many of the source's permuted blocks go to earlier shards. A node of the tree is
    one row with an array over the sources, so the catalogue of sources must fit a row; the levels are
    the logarithm of the number of shards.
    """
    pair = F.struct("number", "blocks")
    nodes = quotas.agg(F.sort_array(F.collect_list(pair)).alias("q")).select(
        F.lit(0).alias("low"), F.lit(n_shards).alias("high"), "q"
    )
    width = n_shards
    while width > 1:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
        middle = ((F.col("low") + F.col("high") + 1) / 2).cast("int")
        open_node = F.col("high") - F.col("low") > 1
        share = F.floor(F.col("total") * (F.col("middle") - F.col("low")) / (F.col("high") - F.col("low")))
        step = nodes.withColumns({"total": total, "middle": middle}).withColumn("wanted", share)

        def take(state: Column, x: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("low"), F.col("high"), x["number"])
            k = _drawn(state["all"], x["blocks"], state["wanted"], u)
            return F.struct(
                (state["all"] - x["blocks"]).alias("all"),
                (state["wanted"] - k).alias("wanted"),
                F.concat(state["k"], F.array(k)).alias("k"),
            )

        start = F.struct(
            F.col("total").alias("all"), F.col("wanted"), F.array().cast("array<bigint>").alias("k")
        )
        step = step.withColumn("k", F.aggregate("q", start, take)["k"])

        def part(left: bool) -> Column:
            def own(x: Column, i: Column) -> Column:
                k = F.get(F.col("k"), i)
                return F.struct(x["number"].alias("number"), (k if left else x["blocks"] - k).alias("blocks"))

            low, high = ("low", "middle") if left else ("middle", "high")
            return F.struct(F.col(low).alias("low"), F.col(high).alias("high"), F.transform("q", own).alias("q"))

        same = F.struct("low", "high", "q")
        nodes = step.select(
            F.explode(F.when(open_node, F.array(part(True), part(False))).otherwise(F.array(same))).alias("n")
        ).select("n.*")
        nodes = written(nodes, "nodes")
        width = (width + 1) // 2
    leaves = nodes.select(F.col("low").alias("shard"), F.explode("q").alias("x")).select("shard", "x.*")
    earlier = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("blocks").over(earlier), F.lit(0))
    return leaves.select("number", "shard", before.alias("before"), "blocks")


def schedule(
    rows: DataFrame, n_shards: int = 16, seed: int = 7, weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """(``row``, ``id``, ``source``, ``size``, ``source_size``, ``target``, ``pass``, ``block``, ``shard``, ``place``).

    ``rows`` has (``row``, ``id``, ``source``, ``size``) with ``row`` unique. One result row per use of
    a document; a document that is not used has one row with a null ``pass``, ``block``, ``shard`` and ``place``.
    ``place`` orders a shard. In its last pass a source takes the documents whose middle lies before what
    is left of the target, so it misses the target by half a document at most.
    """
    catalogue = targets(rows, weights)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    mean = F.sum("target").over(Window.partitionBy()) / (n_shards * SHARD_BLOCKS)
    blocks = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") / F.col("mean"))))
    catalogue = (
        catalogue.withColumn("number", number)
        .withColumn("mean", mean)
        .withColumn("blocks", F.coalesce(blocks, F.lit(0)).cast("long"))
        .drop("mean")
    )
    catalogue = written(catalogue, "sources")
    dealt = split_quotas(catalogue.select("number", "blocks"), n_shards, seed)

    # every block of a source, in permuted order, with the shard it is dealt to: a row per block
    numbered = catalogue.where("blocks > 0").select(
        "number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    )
    shuffled = Window.partitionBy("number").orderBy(F.xxhash64(F.lit(seed), "number", "block"), "block")
    numbered = numbered.withColumn("rank", F.row_number().over(shuffled) - 1)
    b, d = numbered.alias("b"), dealt.alias("d")
    homes = b.join(
        d,
        (F.col("b.number") == F.col("d.number"))
        & (F.col("b.rank") >= F.col("d.before"))
        & (F.col("b.rank") < F.col("d.before") + F.col("d.blocks")),
    ).select(F.col("b.number"), "block", "shard")
    homes = written(homes, "blocks")

    keyed = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    placed = running_totals(keyed, ["key", "id", "size", "row"], {"before": F.col("size")}, ["source"])
    known = catalogue.select(F.col("source").alias("s"), "source_size", "target", "number", "blocks")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("s")))
    last = F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    left = F.col("target") - last * F.col("source_size")
    full = F.when(F.col("source_size") > 0, last + (F.col("before") * 2 + F.col("size") < left * 2).cast("long"))
    uses = F.coalesce(full, F.lit(0)).cast("int")
    passes = F.when(uses > 0, F.sequence(F.lit(0), uses - 1)).otherwise(F.array(F.lit(None).cast("int")))
    used = placed.withColumn("pass", F.explode(passes))
    middle = F.col("pass") * F.col("source_size") + F.col("before") + F.col("size") / 2
    block = F.least(F.col("blocks") - 1, F.floor(F.try_divide(middle * F.col("blocks"), F.col("target"))))
    used = used.withColumn("block", F.when(F.col("pass").isNotNull(), block))
    homes = homes.select(F.col("number").alias("n"), F.col("block").alias("k"), "shard")
    home = (F.col("number") == F.col("n")) & (F.col("block") == F.col("k"))
    place = F.when(F.col("pass").isNotNull(), F.xxhash64(F.lit(seed), "key", "pass", "row"))
    return used.join(homes, home, "left").select(
        "row", "id", "source", "size", "source_size", "target", "pass", "block", "shard", place.alias("place")
    )


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    n_shards: int = 16, seed: int = 7, weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """(id, ``size``, ``source_size``, ``target``, ``taken``) of every row of ``docs``.

    ``taken`` is the words that the shards get of the row, repeats counted: its size once for every use whose block the
    tree has dealt to a shard, at most three times. Only ids, sources and sizes are shuffled.

    Edge cases: a null text has no words; documents without words are never taken. A null source is a
    source of its own, after all others. Null ids share one place in the order. Repeated rows are rows
    of their own. An empty table, or one without words, takes nothing. Other columns are ignored.
    """
    sized = docs.select(
        docs[id_col].alias("id"),
        docs[source_col].alias("source"),
        word_count(docs[text_col]).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    used = schedule(written(sized, "sized"), n_shards, seed, weights)
    taken = F.sum(F.when(F.col("shard").isNotNull(), F.col("size")).otherwise(0))
    rows = used.groupBy("row").agg(
        *(F.first(c).alias(c) for c in ("id", "size", "source_size", "target")), taken.alias("taken")
    )
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    n_shards: int = 16, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, in_files: bool = False,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, as often as they are used, plus shard and place.

    The added columns are ``mix_shard`` and ``mix_place`` (with ``_`` appended if taken); ordering a shard
    by place gives its shuffle. Texts are read twice and shuffled once, to meet the uses of their rows, which are
    told apart by place (see :func:`with_row`, also for ``in_files``).

    Edge cases: a null text has no words and is never taken, as every document without words. A null source is a source
    of its own. Null ids share one place in the order; repeated rows are rows of their own. An empty table, or one
    without words, gives no rows.
    """
    row, shard, place = fresh(docs, "mix_row", "mix_shard", "mix_place")
    placed = with_row(docs, row, in_files)
    sized = placed.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), F.col(row).alias("row"),
    )
    used = schedule(written(sized, "sized"), n_shards, seed, weights).where(F.col("shard").isNotNull())
    used = written(used.select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("place").alias(place)), "uses")
    return placed.join(used.hint("shuffle_hash"), row).drop(row)


def in_shard_order(mix: DataFrame, shard: str, place: str, n_shards: int = 16) -> DataFrame:
    """``mix`` with whole shards one after the other, each in the order of its places.

    A shard is laid out over a fixed number of partitions by the upper bits of the place, a hash, so nothing is
    sampled. Their number follows ``spark.sql.shuffle.partitions``.
    """
    wanted = int(mix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, -(-wanted // n_shards) - 1).bit_length()
    piece = F.shiftright(F.shiftright(place, 1), 63 - bits) + (1 << bits >> 1)  # 0 to 2 ** bits - 1
    number = (F.col(shard) * (1 << bits) + (piece if bits else F.lit(0))).cast("int")
    return mix.repartitionById(n_shards << bits, number).sortWithinPartitions(shard, place)


#: The same words taken in SQL: targets by filling up, then the stream of each source up to its target.
#: The tree deals every block of a stream to one shard, whatever it draws, so all of the stream is taken; which
#: shard gets a block depends on hashes that SQL lacks, and is tested against the exact quotas.
MIXTURE_SQL = r"""
WITH sized AS (SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, source_size * 3 AS most,
        [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per),
    levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER
            (line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
        FROM weighed WINDOW line AS (ORDER BY most / weight, source NULLS LAST)),
    fill AS (SELECT level FROM levels WHERE level * weight <= most ORDER BY most / weight, level LIMIT 1),
    targets AS (SELECT l.source, source_size, least(most::DOUBLE, f.level * weight) AS target
        FROM levels l, fill f),
    placed AS (SELECT doc_id, s.source, size, source_size, target, floor(target / nullif(source_size, 0)) AS whole,
        coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5('7:' || coalesce(doc_id::VARCHAR, '')),
            doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * coalesce(whole
    + CASE WHEN before * 2 + size < (target - whole * source_size) * 2 THEN 1 ELSE 0 END, 0))::BIGINT AS taken
FROM placed"""
