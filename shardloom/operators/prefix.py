"""Prefix aggregates and row numbers that hold up when one group has most of the rows.

A plain window over the group would put a hot shard or run into a single task. Here the key range is
cut into buckets of `fan` keys; a window runs inside each bucket, and the bucket totals, `fan` times
fewer rows, are prefixed the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shardloom.functions.arith import div
from shardloom.operators.lookup import HEAD_ROWS

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
_COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}


def prefix_agg(
    df: DataFrame,
    group: list[str],
    key: str,
    aggs: dict[str, tuple[str, str]],
    fan: int = 16384,
    levels: int = 2,
) -> DataFrame:
    """Add, per row, aggregates over the rows of its group with a smaller key.

    `aggs` maps an output column to (sum | min | max, input column). `key` is an integer unique in the
    group, so a bucket has at most `fan` rows. Nothing before a row gives 0 for sum, null for min and max.
    """
    before = lambda by: W.partitionBy(*by).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    if levels <= 1:
        window = before(group)
        for out, (op, col) in aggs.items():
            value = _MERGE[op](col).over(window)
            df = df.withColumn(out, F.coalesce(value, F.lit(0)) if op == "sum" else value)
        return df

    bucket, name = div(key, fan), f"_bucket_{levels}"
    totals = df.groupBy(*group, bucket.alias(name)).agg(
        *[_MERGE[op](col).alias(f"_total_{out}") for out, (op, col) in aggs.items()]
    )
    totals = prefix_agg(
        totals,
        group,
        name,
        {f"_before_{out}": (op, f"_total_{out}") for out, (op, _) in aggs.items()},
        fan,
        levels - 1,
    ).drop(*[f"_total_{out}" for out in aggs])

    window = before([*group, name])
    inside = df.withColumn(name, bucket)
    for out, (op, col) in aggs.items():
        inside = inside.withColumn(f"_inside_{out}", _MERGE[op](col).over(window))
    joined = inside.join(totals, [*group, name])
    kept = [c for c in df.columns if c not in aggs]
    return joined.select(
        *kept,
        *[
            _COMBINE[op](F.col(f"_before_{out}"), F.col(f"_inside_{out}")).alias(out)
            for out, (op, _) in aggs.items()
        ],
    )


def ordered_index(
    df: DataFrame,
    group: list[str],
    order: list[str],
    out: str,
    stage: Callable[[DataFrame], DataFrame],
    then: Callable[[DataFrame], DataFrame] = lambda placed: placed,
) -> DataFrame:
    """Add the 0-based position of each row in its group under `order` (unique in the group).

    Rows are range partitioned by (group, order), so a hot group spreads over many tasks. The placed
    rows are stored once, because a second evaluation could draw other range borders. `then` maps them
    before they are stored; only its input is shuffled.
    """
    placed = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    stored = stage(then(placed))
    return index_from_runs(stored, group, "_part", "_row", out, stage).drop("_part", "_row")


def index_from_runs(
    df: DataFrame,
    group: list[str],
    run: str,
    row: str,
    out: str,
    stage: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Positions from runs of consecutive `row` ids: one row per (group, run) is all that is summed up.

    That table is stored and counted, so that df itself is not shuffled unless there are very many runs. Pass a
    stored df: it is read twice, and a row whose run is missing is an error.
    """
    runs = df.groupBy(*group, run).agg(F.min(row).alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy(run).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    runs = stage(runs)
    return (
        df.join(F.broadcast(runs) if runs.count() <= HEAD_ROWS else runs, [*group, run], "left")
        .withColumn("_first", F.coalesce("_first", F.raise_error(F.lit("a row of an unknown run")).cast("bigint")))
        .withColumn(out, F.col(row) - F.col("_first") + F.col("_before"))
        .drop("_first", "_before")
    )
