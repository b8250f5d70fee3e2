"""Inputs of the queries, derived from the given tables.

What several queries need, such as tokenized documents, is stored once per session and folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.text import EOS, words, wrap
from shardloom.operators.encode import encode, rank_vocab
from shardloom.operators.prefix import ordered_index
from shardloom.operators.runlog import MODEL_SIZES
from shardloom.operators.splits import TRAIN, rank_shards, split_by_shard
from shardloom.session import stage

LENGTH = 128  # tokens per block in the queries
CHUNK_DOCS = 16  # documents per shuffled chunk in the queries
TRAIN_SHARDS, VAL_SHARDS = 16, 2
VAL_BATCHES = 4  # validation batches per evaluation in the run log

_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], write: bool = True
) -> DataFrame:
    """The table `name`, built on first use and written unless its rows are stored already."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _STORED:
        _STORED[key] = stage(build(), name) if write else build()
    return _STORED[key]


def stager(label: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: stage(df, label)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("source", "shard")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard, shard_rank, split."""
    build = lambda: rank_shards(documents(spark, sf_dir).select("shard").distinct(), TRAIN_SHARDS, VAL_SHARDS)
    return stored(spark, sf_dir, "shards", build)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard, doc_no, doc_id, lang, split, tokens (wrapped words), n; doc_no is the rank of doc_id in its shard."""

    def build() -> DataFrame:
        docs = split_by_shard(documents(spark, sf_dir).drop("n_chars"), shards(spark, sf_dir))
        return ordered_index(docs, ["shard"], ["doc_id"], "doc_no", stager("tokens"), tokenize)

    def tokenize(docs: DataFrame) -> DataFrame:
        tokenized = docs.withColumn("tokens", wrap(words("text"), EOS)).drop("text")
        return tokenized.withColumn("n", F.size("tokens").cast("bigint"))

    return stored(spark, sf_dir, "tokens", build, write=False)


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, id: words of the train split by falling count, then the special tokens."""

    def build() -> DataFrame:
        train = tokens(spark, sf_dir).filter(F.col("split") == TRAIN)
        counts = train.select(F.explode("tokens").alias("token")).filter(F.col("token") != EOS)
        return rank_vocab(counts.groupBy("token").agg(F.count("*").alias("n")), stager("ranked-vocab"))

    return stored(spark, sf_dir, "vocab", build)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens table with ids instead of words."""

    def build() -> DataFrame:
        key = ["shard", "doc_no", "doc_id", "lang", "split", "n"]
        return encode(tokens(spark, sf_dir), key, vocab(spark, sf_dir))

    return stored(spark, sf_dir, "encoded", build)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, split, global_step, batch_idx, loss from the events of each user."""

    def build() -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        kind = F.col("event_type")
        split = (
            F.when(kind.isin("view", "click"), "train")
            .when(kind.isin("purchase", "error"), "validation")
            .when(kind == "signup", "test")
        )
        rows = events.select(F.col("user_id").alias("run_id"), split.alias("split"), "ts", "event_id", (F.col("value") / 100).alias("loss"))
        ranked = ordered_index(rows, ["run_id", "split"], ["ts", "event_id"], "r", stager("ranked-events"))
        validation = F.col("split") == "validation"
        step = F.when(validation, F.floor(F.col("r") / VAL_BATCHES)).otherwise(F.col("r")).cast("bigint")
        batch = F.when(validation, F.col("r") % VAL_BATCHES).otherwise(0).cast("bigint")
        return ranked.select("run_id", "split", step.alias("global_step"), batch.alias("batch_idx"), "loss")

    return stored(spark, sf_dir, "run_log", build, write=False)


def run_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run with settings that vary by run; every second run leaves its learning rate to its size."""

    def build() -> DataFrame:
        run = F.col("run_id")
        sizes = F.array(*[F.lit(s[0]) for s in MODEL_SIZES])
        starts = run_log(spark, sf_dir).select("run_id").distinct()
        return starts.select(
            "run_id",
            F.get(sizes, (run % len(MODEL_SIZES)).cast("int")).alias("size"),
            (F.lit(8) * (run % 3 + 1)).cast("bigint").alias("batch_size"),
            F.lit(LENGTH).cast("bigint").alias("n_ctx"),
            F.when(run % 2 == 0, F.lit(-1.0)).otherwise(F.lit(0.001) * (run % 5 + 1)).alias("lr"),
            F.lit(-1).cast("bigint").alias("d_embd"),
            F.lit(3).cast("bigint").alias("warmup"),
            F.lit(20).cast("bigint").alias("max_step"),
            (run % 4 - 1).cast("bigint").alias("limit_train_batches"),
            (run % 3).cast("bigint").alias("eval_interval"),
        )

    return stored(spark, sf_dir, "run_params", build)
