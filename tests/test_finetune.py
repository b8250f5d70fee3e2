"""Per-file batches, per-run budgets and file listing against plain versions."""

import json

import pytest
from pyspark.sql import functions as F

from shardloom.functions.text import EOS
from shardloom.operators import batching
from shardloom.plans import finetune
from shardloom.sources import readers


def test_file_batches(spark, tmp_path):
    """Parts of a folder follow each other by name, files do not mix, and partial batches and tails go."""
    parts = {("a", 0): ["one two", "", "three"], ("a", 1): ["four five six seven"], ("b", 0): ["x y z"] * 7, ("c", 0): ["short"]}
    for (file, k), texts in parts.items():
        folder = tmp_path / f"file={file}"
        folder.mkdir(exist_ok=True)
        (folder / f"part-{k}.json").write_text("".join(json.dumps({"content": t}) + "\n" for t in texts))
    want = []
    for file in "abc":
        tokens = [t for (f, _), texts in sorted(parts.items()) if f == file for text in texts for t in (EOS, *text.split(), EOS)]
        blocks = [tokens[i : i + 4] for i in range(0, (len(tokens) - 1) // 4 * 4, 4)]
        want += [(file, i // 2, i % 2, block, 4) for i, block in enumerate(blocks) if i // 2 < len(blocks) // 2]
    got = finetune.file_batches(spark, str(tmp_path), 4, 2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("n_blocks", [0, 7, 100])
def test_budgets_and_evaluations(spark, n_blocks):
    runs = [(k, size, batch, 16, limit, every) for k, (size, batch, limit, every) in enumerate(
        (s, b, m, e) for s in ("small", "x6small") for b in (1, 16, 24) for m in (-1, 0, 1, 3, 99) for e in (-1, 0, 1, 2, 50)
    )]
    df = spark.createDataFrame(runs, "run_id bigint, size string, batch_size bigint, n_ctx bigint, limit_train_batches bigint, eval_interval bigint")
    budgets = batching.run_budgets(df, n_blocks, 21, 5, 3)
    rows = {r.run_id: r for r in budgets.collect()}
    evals = {}
    for r in batching.run_evaluations(budgets).collect():
        evals.setdefault(r.run_id, []).append((r.eval_no, r.batch_id, r.from_block, r.to_block))
    for run_id, size, batch, n_ctx, limit, every in runs:
        mini = 2 if size == "small" else 8
        accumulate = batch // mini if batch >= mini else 1
        batches = [b for b in range(n_blocks // mini) if limit <= 0 or b < limit * accumulate]
        due = [b for b in batches if ((b + 1) % (every * accumulate) == 0 if every > 0 else b == batches[-1])]
        r = rows[run_id]
        assert (r.n_batches, r.n_tokens, r.n_evals, r.val_batches) == (len(batches), len(batches) * mini * n_ctx, len(due), 3)
        assert r.n_steps == len({b // accumulate for b in batches})
        since = [0, *(b + 1 for b in due)]
        want = [(i, b, since[i] * mini, (b + 1) * mini) for i, b in enumerate(due)]
        assert sorted(evals.get(run_id, [])) == want


def test_evaluations_of_one_run_are_listed_by_many_tasks(spark):
    runs = spark.createDataFrame([(1, "small", 2, 16, -1, 1)], "run_id bigint, size string, batch_size bigint, n_ctx bigint, limit_train_batches bigint, eval_interval bigint")
    listed = batching.run_evaluations(batching.run_budgets(runs.coalesce(1), 200_000, 21, 5, 3))
    parts = listed.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.min("eval_no").alias("low"), F.max("eval_no").alias("high")).collect()
    assert sum(r.n for r in parts) == 100_000 and len(parts) > 4
    assert (min(r.low for r in parts), max(r.high for r in parts)) == (0, 99_999)


def test_files_are_listed_without_reading(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in (("a.txt", b""), ("deep/b.jsonl.zst", b"not zstd at all"), ("c d", b"xyz")):
        (tmp_path / name).write_bytes(content)
    found = readers.list_files(spark, str(tmp_path))
    assert sorted((r.shard.split(f"{tmp_path.name}/")[1], r.n_bytes) for r in found.collect()) == [("a.txt", 0), ("c d", 3), ("deep/b.jsonl.zst", 15)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
