"""Queries on fine-tuning: per-file batches of field files, and budgets and evaluations by each run's own settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.text import EOS, words, wrap
from shardloom.operators import batching, ordering, packing
from shardloom.operators.lookup import attach
from shardloom.operators.prefix import index_from_runs
from shardloom.operators.runlog import MODEL_SIZES
from shardloom.operators.splits import split_by_shard
from shardloom.plans import sql, tables
from shardloom.plans.corpus import BATCH
from shardloom.plans.registry import query
from shardloom.plans.sql import TOKENS, packed
from shardloom.plans.tables import LENGTH, stager
from shardloom.session import new_path
from shardloom.sources import readers


def field_files(spark: SparkSession, sf_dir: str) -> str:
    """JSON lines with a `content` field, a folder per language and split; documents in doc_id order over a folder's parts."""
    docs = split_by_shard(tables.documents(spark, sf_dir).select("shard", "doc_id", "lang", "text"), tables.shards(spark, sf_dir))
    line = F.to_json(F.struct(F.col("text").alias("content"), F.col("doc_id").alias("qid")))
    placed = docs.select(F.concat_ws("_", "lang", "split").alias("file"), "doc_id", line.alias("value"))
    path = new_path(spark, "field-files")
    placed = placed.repartitionByRange("file", "doc_id").sortWithinPartitions("file", "doc_id")
    placed.select("file", "value").write.partitionBy("file").text(path)
    return path


def file_batches(spark: SparkSession, path: str, length: int, batch: int) -> DataFrame:
    """From field files to batches: file, batch_id, slot, tokens, n_block (the block's length, these sources' provenance).

    Every file is packed and batched for itself, in file order, and its partial last batch is dropped. Where a document stands
    follows from line numbers and the number of lines of a folder's earlier parts; blocks, from token counts.
    """
    lines = readers.read_field(spark, path).withColumn("file", F.regexp_extract("shard", "file=([^/]+)/", 1))
    tokens = wrap(words("text"), EOS)
    docs = lines.select("file", "shard", F.col("doc_no").alias("line"), tokens.alias("tokens"))
    docs = stager("field-docs")(docs.withColumn("n", F.size("tokens").cast("bigint")))
    docs = index_from_runs(docs, ["file"], "shard", "line", "doc_no", stager("field-parts"))
    docs = ordering.place_in_chunks(docs.select("file", "doc_no", "tokens", "n"))
    blocks = packing.pack(docs, ["file"], ["doc_no"], length)
    counts = packing.count_blocks(docs.select("file", "n"), ["file"], length).select("file", "n_blocks")
    sized = attach(blocks.select("file", "block_no", "tokens"), ["file"], stager("field-counts")(counts), F.col("block_no"))
    batched = batching.batch_blocks(sized, "block_no", "n_blocks", batch)
    return batched.select("file", "batch_id", "slot", "tokens", F.size("tokens").cast("bigint").alias("n_block"))


@query(f"""WITH {TOKENS}, in_order AS (SELECT *, 0 AS doc_i FROM tokens), {packed("lang, split", "doc_id", "in_order")},
sized AS (SELECT *, count(*) OVER (PARTITION BY lang, split) AS n_blocks FROM blocks)
SELECT lang || '_' || split AS file, block_no // {BATCH} AS batch_id, count(*) AS n_rows,
       md5(string_agg(array_to_string(tokens, ' '), '|' ORDER BY block_no)) AS matrix, string_agg(len(tokens), ' ' ORDER BY block_no) AS meta
FROM sized WHERE block_no // {BATCH} < n_blocks // {BATCH} GROUP BY lang, split, block_no // {BATCH}""")
def finetune_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field files, read back, tokenized, packed and batched file by file."""
    batched = file_batches(spark, field_files(spark, sf_dir), LENGTH, BATCH)
    rows = batching.collate(batched, ["file"], meta="n_block")
    lines = F.transform("matrix", lambda r: F.array_join(r, " "))
    return rows.select(
        "file",
        "batch_id",
        F.size("matrix").cast("bigint").alias("n_rows"),
        F.md5(F.array_join(lines, "|")).alias("matrix"),
        F.array_join(F.transform("meta", lambda n: n.cast("string")), " ").alias("meta"),
    )


MAX_EVAL_STEPS, EVAL_BATCH = 4, 5
_BUDGETS = f"""{sql.run_params([s[0] for s in MODEL_SIZES])}, {TOKENS.lstrip()},
per_shard AS (SELECT split, (sum(len(tokens)) - 1) // {LENGTH} AS n FROM tokens GROUP BY split, shard),
minis AS (SELECT *, CASE WHEN size IN ('x2small', 'small') THEN 2 ELSE 8 END AS mini FROM run_params),
steps AS (SELECT *, CASE WHEN batch_size >= mini THEN batch_size // mini ELSE 1 END AS accumulate FROM minis),
epochs AS (SELECT *, coalesce((SELECT sum(n) FROM per_shard WHERE split = 'train'), 0) // mini AS whole FROM steps),
kept AS (SELECT *, CASE WHEN limit_train_batches > 0 THEN least(limit_train_batches * accumulate, whole) ELSE whole END AS n_batches,
                CASE WHEN eval_interval > 0 THEN eval_interval * accumulate END AS interval FROM epochs)"""


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = packing.count_blocks(tables.tokens(spark, sf_dir).select("split", "shard", "n"), ["split", "shard"], LENGTH)
    blocks = {r.split: r.n for r in counts.groupBy("split").agg(F.sum("n_blocks").alias("n")).collect()}  # three splits at most
    runs = tables.run_params(spark, sf_dir).select("run_id", "size", "batch_size", "n_ctx", "limit_train_batches", "eval_interval")
    return batching.run_budgets(runs, blocks.get("train", 0), blocks.get("val", 0), EVAL_BATCH, MAX_EVAL_STEPS)


@query(f"""WITH {_BUDGETS}
SELECT run_id, n_batches::BIGINT AS n_batches, ((n_batches + accumulate - 1) // accumulate)::BIGINT AS n_steps, (n_batches * mini * n_ctx)::BIGINT AS n_tokens,
       (limit_train_batches * batch_size * n_ctx)::BIGINT AS dataset_size,
       CASE WHEN eval_interval > 0 THEN n_batches // interval WHEN n_batches > 0 THEN 1 ELSE 0 END::BIGINT AS n_evals FROM kept""")
def run_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch under each run's own limit_train_batches."""
    return _budgets(spark, sf_dir).select("run_id", "n_batches", "n_steps", "n_tokens", "dataset_size", "n_evals")


@query(f"""WITH {_BUDGETS},
batches AS (SELECT run_id, unnest(range(n_batches::BIGINT)) AS batch_id, n_batches, interval, mini FROM kept),
due AS (SELECT *, coalesce(lag(batch_id) OVER (PARTITION BY run_id ORDER BY batch_id) + 1, 0) AS since FROM batches
        WHERE CASE WHEN interval > 0 THEN (batch_id + 1) % interval = 0 ELSE batch_id + 1 = n_batches END)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY batch_id) - 1 AS eval_no, batch_id, (since * mini)::BIGINT AS from_block,
       ((batch_id + 1) * mini)::BIGINT AS to_block,
       least({MAX_EVAL_STEPS}, coalesce((SELECT sum(n) FROM per_shard WHERE split = 'val'), 0) // {EVAL_BATCH})::BIGINT AS val_batches FROM due""")
def run_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After which micro-batches each run evaluates by its own eval_interval, and the blocks trained in between."""
    return batching.run_evaluations(_budgets(spark, sf_dir)).select("run_id", "eval_no", "batch_id", "from_block", "to_block", "val_batches")
