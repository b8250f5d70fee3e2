"""Batches, optimizer steps, data budgets and the evaluation schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.arith import div

# Micro-batch sizes by model size.
SMALL_MINI_BATCH, MINI_BATCH = 2, 8
SMALL_MINI_BATCH_SIZES = ("x2small", "small")
EVAL_RANGE = 4_096  # evaluations of a run that are listed together


def batch_blocks(blocks: DataFrame, seq: str, total: str, batch_size: int) -> DataFrame:
    """Consecutive blocks of a sequence form batches; a partial last batch is left out.

    `seq` numbers the blocks 0, 1, 2, ... and `total` is how many there are, so no sort is needed.
    """
    placed = blocks.withColumn("batch_id", div(seq, batch_size)).withColumn("slot", (F.col(seq) % batch_size).cast("bigint"))
    return placed.filter(F.col("batch_id") < div(total, batch_size))


def collate(batched: DataFrame, scope: list[str], meta: str = "trigger") -> DataFrame:
    """One row per batch: the token matrix and the provenance list, both in slot order."""
    rows = F.array_sort(F.collect_list(F.struct("slot", "tokens", F.col(meta).alias("meta"))))
    return batched.groupBy(*scope, "batch_id").agg(rows.alias("rows")).select(
        *scope,
        "batch_id",
        F.transform("rows", lambda r: r["tokens"]).alias("matrix"),
        F.transform("rows", lambda r: r["meta"]).alias("meta"),
    )


def mini_batch_size(size: Column) -> Column:
    return F.when(size.isin(*SMALL_MINI_BATCH_SIZES), SMALL_MINI_BATCH).otherwise(MINI_BATCH)


def accumulate_batches(batch_size: Column, mini: Column) -> Column:
    """Micro-batches per optimizer step."""
    return F.when(batch_size >= mini, div(batch_size, mini)).otherwise(1).cast("bigint")


def optimizer_step(batch_id: Column, accumulate: Column) -> Column:
    return div(batch_id, accumulate)


def within_budget(batch_id: Column, limit: Column, accumulate: Column) -> Column:
    """The first limit * accumulate micro-batches of an epoch; a limit of zero or less keeps all."""
    return (limit <= 0) | (batch_id < limit * accumulate)


def budget_tokens(limit: Column, batch_size: Column, n_ctx: Column) -> Column:
    return (limit * batch_size * n_ctx).cast("bigint")


def evaluation_interval(eval_interval: Column, accumulate: Column, mode: str = "single") -> Column:
    """Micro-batches between evaluations, null for once per epoch; the multi-device mode does not scale."""
    scaled = eval_interval * accumulate if mode == "single" else eval_interval
    return F.when(eval_interval > 0, scaled.cast("bigint"))


def validation_limit(max_eval_steps: Column, accumulate: Column, mode: str = "single") -> Column:
    """Validation batches per evaluation; the multi-device mode scales this one instead."""
    return (max_eval_steps if mode == "single" else max_eval_steps * accumulate).cast("bigint")


def evaluates_after(batch_id: Column, n_batches: Column, interval: Column) -> Column:
    """Whether an evaluation follows this micro-batch."""
    return F.coalesce((batch_id + 1) % interval == 0, batch_id + 1 == n_batches)


def kept_batches(n_batches: Column, limit: Column, accumulate: Column) -> Column:
    """How many micro-batches of an epoch a budget keeps."""
    return F.when(limit > 0, F.least(limit * accumulate, n_batches)).otherwise(n_batches).cast("bigint")


def run_budgets(runs: DataFrame, n_blocks: int, val_blocks: int, val_batch: int, max_eval_steps: int) -> DataFrame:
    """What an epoch of n_blocks is for each run, by arithmetic on its settings: no block or batch is listed.

    runs(size, batch_size, n_ctx, limit_train_batches, eval_interval) get mini, accumulate, n_batches (kept), n_steps, n_tokens,
    dataset_size, interval (micro-batches between evaluations), n_evals and val_batches (per evaluation). An interval of zero or
    less, and one longer than what is kept, gives one evaluation at the end or none, as the schedule of an epoch does.
    """
    mini = mini_batch_size(F.col("size")).cast("bigint")
    found = runs.withColumn("mini", mini).withColumn("accumulate", accumulate_batches(F.col("batch_size"), F.col("mini")))
    whole = div(F.lit(n_blocks), F.col("mini"))
    found = found.withColumn("n_batches", kept_batches(whole, F.col("limit_train_batches"), F.col("accumulate")))
    found = found.withColumn("interval", evaluation_interval(F.col("eval_interval"), F.col("accumulate")))
    once = F.when(F.col("n_batches") > 0, F.lit(1)).otherwise(0)
    return found.select(
        *runs.columns,
        "mini",
        "accumulate",
        "n_batches",
        div(F.col("n_batches") + F.col("accumulate") - 1, F.col("accumulate")).alias("n_steps"),
        (F.col("n_batches") * F.col("mini") * F.col("n_ctx")).alias("n_tokens"),
        budget_tokens(F.col("limit_train_batches"), F.col("batch_size"), F.col("n_ctx")).alias("dataset_size"),
        "interval",
        F.coalesce(div("n_batches", F.col("interval")), once).cast("bigint").alias("n_evals"),
        F.least(F.lit(max_eval_steps), div(F.lit(val_blocks), val_batch)).cast("bigint").alias("val_batches"),
    )


def run_evaluations(budgets: DataFrame) -> DataFrame:
    """One row per evaluation of a run's epoch: the micro-batch it follows, and the blocks [from, to) trained since the last.

    There are as many rows as runs times evaluations, from few rows of settings: ranges of EVAL_RANGE evaluations are dealt
    out to tasks before they are listed, so neither the runs nor one run's evaluations stay in a single task or array. The same
    range of runs with the same batches stays together, as its numbers are the same: columnar files hold them once.
    """
    counted = budgets.filter("n_evals > 0").select("*", F.explode(F.sequence(F.lit(0), div(F.col("n_evals") - 1, EVAL_RANGE))).alias("_range"))
    tasks = int(budgets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, else the few bytes before listing would be taken together
    alike = [F.coalesce("interval", "n_batches"), F.col("mini"), F.col("_range"), F.col("run_id")]
    counted = counted.repartitionByRange(tasks, *alike).sortWithinPartitions(*alike)
    first = F.col("_range") * EVAL_RANGE
    listed = F.sequence(first, F.least(first + EVAL_RANGE, F.col("n_evals")) - 1)
    counted = counted.select(*budgets.columns, F.explode(listed).alias("eval_no"))
    length = F.coalesce("interval", "n_batches")
    return counted.select(
        *budgets.columns,
        F.col("eval_no").cast("bigint").alias("eval_no"),
        ((F.col("eval_no") + 1) * length - 1).cast("bigint").alias("batch_id"),
        (F.col("eval_no") * length * F.col("mini")).cast("bigint").alias("from_block"),
        ((F.col("eval_no") + 1) * length * F.col("mini")).cast("bigint").alias("to_block"),
    )
