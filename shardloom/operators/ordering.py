"""Seeded document shuffle, shard order per stream, repeated passes and round-robin interleave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shardloom.functions.arith import div
from shardloom.functions.text import seeded_key
from shardloom.operators.lookup import attach

CHUNK_DOCS = 20_000  # fixed value: documents per shuffled chunk


def place_in_chunks(docs: DataFrame, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """Chunk number of each document in file order."""
    return docs.withColumn("chunk", div("doc_no", chunk_docs))


def shuffle_key(seed: Column) -> Column:
    return seeded_key(seed, "shard", "doc_no")


def shuffle_docs(docs: DataFrame, seed: Column, chunk_docs: int = CHUNK_DOCS, scope: tuple[str, ...] = ("shard",)) -> DataFrame:
    """Shuffle the documents of each chunk by seed; `doc_i` is the place inside the shuffled chunk.

    A window partition is one chunk, so it has at most chunk_docs rows however large its shard is.
    """
    window = W.partitionBy(*scope, "chunk").orderBy("shuffle_key")
    keyed = place_in_chunks(docs, chunk_docs).withColumn("shuffle_key", shuffle_key(seed))
    return keyed.withColumn("doc_i", F.row_number().over(window) - 1)


def shard_order(shards: DataFrame, n_streams: int) -> DataFrame:
    """Each stream visits all shards in its own seeded order."""
    streams = F.explode(F.sequence(F.lit(0), F.lit(n_streams - 1))).alias("stream")
    pairs = shards.select("shard", streams)
    window = W.partitionBy("stream").orderBy(seeded_key(F.col("stream"), "shard"), "shard")
    return pairs.withColumn("shard_pos", F.row_number().over(window) - 1)


def add_streams(docs: DataFrame, n_streams: int) -> DataFrame:
    """One copy of the documents per stream; the seed of a stream is its number."""
    return docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_streams - 1))).alias("stream"))


def repeat_epochs(rows: DataFrame, n_epochs: int) -> DataFrame:
    """The same rows once per epoch, in the same order each time."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))).alias("epoch"))


def stream_offsets(block_counts: DataFrame, order: DataFrame) -> DataFrame:
    """Blocks before each shard in its stream's pass, and the pass length; one row per (stream, shard)."""
    counted = order.join(block_counts, ["stream", "shard"], "left").fillna(0, ["n_blocks"])
    before = W.partitionBy("stream").orderBy("shard_pos").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("stream")
    return counted.select(
        "stream",
        "shard",
        "shard_pos",
        F.coalesce(F.sum("n_blocks").over(before), F.lit(0)).alias("shard_offset"),
        F.sum("n_blocks").over(whole).alias("pass_blocks"),
    )


def interleave(blocks: DataFrame, offsets: DataFrame, n_streams: int, n_epochs: int = 1) -> DataFrame:
    """Block k of every stream in turn: a sequence number by arithmetic, without a global sort."""
    placed = repeat_epochs(attach(blocks, ["stream", "shard"], offsets, F.col("block_no")), n_epochs)
    k = F.col("epoch") * F.col("pass_blocks") + F.col("shard_offset") + F.col("block_no")
    return placed.withColumn("mix_seq", (k * n_streams + F.col("stream")).cast("bigint"))
