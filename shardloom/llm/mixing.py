"""Mix sources to target weights: hash-random keys, a range sort in each source, prefix sums of sizes, a cut at each budget.

Nulls: a null text has size 0, a null source is a source of its own (last in rank), a null doc_id sorts first.
Sources of size 0 get target 0. Rows that repeat are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shardloom.llm.common import WORD
from shardloom.operators.prefix import ordered_index
from shardloom.session import stage

SOURCE = ("_no_source", "_source")
IDENTITY = ("_no_id", "_id", *SOURCE, "_text")
STAGE = lambda df: stage(df, "mix")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _identity() -> list[Column]:
    """Columns without nulls that tell documents apart, if not fully equal ones."""
    return [
        F.col("doc_id").isNull().alias("_no_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"),
        F.col("source").isNull().alias("_no_source"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.xxhash64("text").alias("_text"),
    ]


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most_epochs: int) -> DataFrame:
    """One row per source: its size, its target, and the whole passes and the rest of the target in words.

    Sources rank by code point, null last, and take the weights in turn. A target over most_epochs times its
    source's size stops there; what is left over is shared by weight among the others, until none is above.
    Each round is one aggregation of the table of sources, whatever their number.
    """
    sources = sizes.groupBy(*SOURCE).agg(F.sum("_size").alias("_total"))
    sources = STAGE(ordered_index(sources, [], [*SOURCE], "_rank", STAGE))
    turn = F.pmod("_rank", F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("bigint")
    sources = sources.select(*SOURCE, "_total", weight.alias("_weight"), (F.col("_total") * most_epochs).alias("_most"))

    whole = (sources.agg(F.sum("_total")).first()[0] or 0) * share
    left, over = whole, 1
    above = F.lit(False)
    stopped = -1
    while True:
        free = F.when(above, 0).otherwise(F.col("_weight"))
        fixed = F.when(above, F.col("_most")).otherwise(0)
        row = sources.agg(F.sum(free).alias("w"), F.sum(fixed).alias("m"), F.count_if(above).alias("n")).first()
        if row.n == stopped:
            break
        stopped, left, over = row.n, whole - (row.m or 0), row.w or 0
        above = F.col("_most") * F.lit(float(over)) <= F.lit(float(left)) * F.col("_weight")
    shared = F.lit(float(left)) * F.col("_weight") / F.lit(float(over or 1))
    target = F.when(above, F.col("_most").cast("double")).otherwise(shared)
    return (
        sources.select(*SOURCE, "_total", target.alias("_target"))
        .withColumn("_budget", F.floor("_target").cast("bigint"))
        .withColumn("_passes", F.when(F.col("_total") > 0, F.expr("_budget div _total")).otherwise(0).cast("bigint"))
        .withColumn("_rest", F.col("_budget") - F.col("_passes") * F.col("_total"))
        .drop("_budget")
    )


def plan(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, most_epochs: int = 3, seed: int = 0
) -> DataFrame:
    """What each document gives: doc_id, its size, its source's size and target, and the words taken of it.

    Every source is taken in whole passes and then, in the order of its random keys, up to exactly the rest of
    its budget; the document at the cut gives its first words only. The same input and seed give the same plan.
    Only ids, keys and sizes are shuffled. They are ranged over (source, key), so a hot source spreads over
    many tasks.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    narrow = docs.select(*_identity(), key.alias("_key"), n_words(F.col("text")).alias("_size"))
    sizes = STAGE(narrow)
    sources = STAGE(targets(sizes, weights, share, most_epochs))
    order = [*SOURCE, "_key", "_no_id", "_id", "_text"]
    placed = STAGE(
        sizes.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    before = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(*SOURCE, "_part").agg(F.sum("_size").alias("_in_part"))
    parts = parts.withColumn("_earlier", F.coalesce(F.sum("_in_part").over(before(SOURCE, "_part")), F.lit(0)))
    parts = STAGE(parts.join(sources, [*SOURCE]).drop("_in_part"))
    inside = F.coalesce(F.sum("_size").over(before([*SOURCE, "_part"], "_row")), F.lit(0))
    rows = placed.withColumn("_inside", inside).join(parts, [*SOURCE, "_part"])
    room = F.col("_rest") - F.col("_earlier") - F.col("_inside")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), room))
    return rows.select(
        *IDENTITY,
        F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        F.when(F.col("_size") > 0, F.col("_passes")).otherwise(0).alias("_passes"),
        part.alias("_part_words"),
        (F.col("_passes") * F.col("_size") + part).cast("bigint").alias("taken"),
    )


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    return plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with all columns of docs: one row per pass, and the cut document's first words.

    Documents without words have nothing to give and go. Texts are shuffled once, to meet their plan.
    """
    takes = F.sort_array(F.collect_list(F.struct("_passes", "_part_words", "size")), asc=False)
    plans = plan(docs, **options).groupBy(*IDENTITY).agg(takes.alias("_takes"))
    same = W.partitionBy(*IDENTITY).orderBy(F.lit(0))
    given = F.struct(*[F.col(c) for c in docs.columns]).alias("_given")  # so that no name of theirs meets one of ours
    rows = docs.select(given, *_identity()).withColumn("_copy", F.row_number().over(same))
    take = F.element_at("_takes", F.col("_copy"))
    words = F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(options.get("most_epochs", 3))), lambda i: F.when(i <= take["_passes"], take["size"])),
        F.array(F.when(take["_part_words"] > 0, take["_part_words"])),
    )
    taken = rows.join(plans, [*IDENTITY]).withColumn("_size", take["size"]).withColumn("_words", F.explode(F.array_compact(words)))
    text = F.col("_given")["text"]
    text = F.when(F.col("_words") < F.col("_size"), first_words(text, F.col("_words"))).otherwise(text)
    return taken.select(*[(text if c == "text" else F.col("_given")[c]).alias(c) for c in docs.columns])
