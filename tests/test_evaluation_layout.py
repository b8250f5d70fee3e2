"""Where the rows of evaluations lie."""

from pyspark.sql import functions as F

from shardloom.operators import batching


def test_equal_ranges_of_runs_lie_together(spark, monkeypatch):
    """Twelve runs of the same settings: a range's numbers are in one or two tasks, not in all, so that files hold them once."""
    monkeypatch.setattr(batching, "EVAL_RANGE", 10)
    fields = "run_id bigint, size string, batch_size bigint, n_ctx bigint, limit_train_batches bigint, eval_interval bigint"
    runs = spark.createDataFrame([(i, "small", 8, 128, -1, 1) for i in range(12)], fields)
    budgets = batching.run_budgets(runs, 2 * 4 * 240, 100, 2, 4)
    rows = batching.run_evaluations(budgets).withColumn("task", F.spark_partition_id())
    assert rows.count() == 12 * 240 == rows.select("run_id", "eval_no").distinct().count()
    where = rows.groupBy("batch_id").agg(F.countDistinct("task").alias("tasks")).agg(F.avg("tasks")).first()[0]
    assert rows.select("task").distinct().count() > 4 and where < 2
