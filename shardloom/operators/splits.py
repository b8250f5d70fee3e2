"""Routing documents to train, validation and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shardloom.operators.lookup import attach

# Shard counts and split names.
TRAIN_SHARDS, VAL_SHARDS = 80, 10
TRAIN, VAL, TEST = "train", "val", "test"
FILE_SPLITS = {"train": TRAIN, "valid": VAL, "test": TEST, "testa": TEST}


def rank_shards(shards: DataFrame, n_train: int = TRAIN_SHARDS, n_val: int = VAL_SHARDS) -> DataFrame:
    """Shards in name order; the first n_train are train, the next n_val validation, the rest test.

    The window has no partition key: its input is one row per shard, a list the driver's file index
    already holds.
    """
    ranked = shards.withColumn("shard_rank", F.row_number().over(W.orderBy("shard")) - 1)
    split = (
        F.when(F.col("shard_rank") < n_train, TRAIN).when(F.col("shard_rank") < n_train + n_val, VAL).otherwise(TEST)
    )
    return ranked.withColumn("split", split)


def split_by_shard(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    return attach(docs, ["shard"], ranked.select("shard", "split"), F.struct(*docs.columns))


def split_of_file(path: Column | str) -> Column:
    """The split a file name stands for: train/valid/test.txt or web_text_zh_{train,valid,testa}.json; else null."""
    name = F.regexp_extract(path, r"(?:^|/)(?:(train|valid|test)\.txt|web_text_zh_(train|valid|testa)\.json)$", 0)
    stem = F.regexp_extract(name, r"(train|valid|testa|test)\.", 1)
    mapping = F.create_map(*[F.lit(x) for pair in FILE_SPLITS.items() for x in pair])
    return mapping[stem]
