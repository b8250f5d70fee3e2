"""Token ids from a vocabulary and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.text import SPECIALS, UNK, words
from shardloom.operators.lookup import HEAD_ROWS, joined, map_items
from shardloom.operators.prefix import ordered_index

def word_counts(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Pre-tokens and how often they occur."""
    return docs.select(*by, F.explode(words(text)).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def rank_vocab(counts: DataFrame, stage) -> DataFrame:
    """Ids by falling count, equal counts by token; the special tokens follow."""
    ranked = ordered_index(counts.withColumn("_down", -F.col("n")), [], ["_down", "token"], "id", stage)
    return add_specials(ranked.select("token", "id"))


def add_specials(vocab: DataFrame) -> DataFrame:
    """Append the special tokens after the highest id."""
    size = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    specials = vocab.sparkSession.createDataFrame([(t, size + i) for i, t in enumerate(SPECIALS)], "token string, id bigint")
    return vocab.select("token", "id").unionByName(specials)


def special_ids(vocab: DataFrame) -> dict[str, int]:
    """Ids of the special tokens, three rows at most."""
    return {r["token"]: r["id"] for r in vocab.filter(F.col("token").isin(*SPECIALS)).collect()}


def encode(docs: DataFrame, key: list[str], vocab: DataFrame, tokens: str = "tokens", out: str = "ids") -> DataFrame:
    """Ids of word tokens; words outside the vocabulary get the id of the unknown token."""
    unknown = special_ids(vocab)[UNK]
    hot = (F.col("id") < HEAD_ROWS) | F.col("token").isin(*SPECIALS)
    table = vocab.select(F.col("token").alias("item"), F.col("id").alias("value"), hot.alias("hot"))
    return map_items(docs, key, tokens, table, unknown, out)


def decode(blocks: DataFrame, key: list[str], vocab: DataFrame, ids: str = "tokens", out: str = "text") -> DataFrame:
    """Text of token ids, special tokens skipped."""
    special = F.col("token").isin(*SPECIALS)
    table = vocab.select(
        F.col("id").alias("item"),
        F.when(special, F.lit("")).otherwise(F.col("token")).alias("value"),
        ((F.col("id") < HEAD_ROWS) | special).alias("hot"),
    )
    return map_items(blocks, key, ids, table, "", out, made=joined(" "))
