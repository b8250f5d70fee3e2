"""Queries on sources, sinks and vocabularies: what is written comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators import encode, splits
from shardloom.plans import tables
from shardloom.plans.registry import query
from shardloom.plans.sql import TOKENS, VOCAB
from shardloom.session import new_path
from shardloom.sources import readers, writers


def _described(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("SELECT doc_id, lang, length(text) AS n_chars, md5(text) AS digest FROM documents")
def read_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, text as a string or as a list of paragraphs, compressed."""
    docs = tables.documents(spark, sf_dir)
    meta = F.struct("doc_id", "lang").alias("meta")
    listed = F.to_json(F.struct(F.split("text", "\n\n").alias("text"), meta))
    line = F.when(F.col("doc_id") % 2 == 0, listed).otherwise(F.to_json(F.struct("text", meta)))
    path = new_path(spark, "jsonl")
    writers.write_jsonl(docs.select(line), path, "gzip")
    back = readers.read_jsonl(spark, path, get_meta=True)
    meta_of = lambda field: F.get_json_object("meta", f"$.{field}")
    return _described(back, meta_of("doc_id").cast("bigint").alias("doc_id"), meta_of("lang").alias("lang"))


@query("SELECT length(text) AS n_chars, md5(text) AS digest FROM documents")
def read_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "field")
    line = F.to_json(F.struct(F.col("text").alias("content"), F.col("doc_id").alias("qid")))
    writers.write_jsonl(tables.documents(spark, sf_dir).select(line), path, "none")
    return _described(readers.read_field(spark, path))


@query("SELECT length(line) AS n_chars, md5(line) AS digest FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lines")
    tables.documents(spark, sf_dir).select("text").write.text(path)
    return _described(readers.read_lines(spark, path))


@query("SELECT length(text) + 1 AS n_chars, md5(text || chr(10)) AS digest FROM documents")
def read_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document."""
    path = new_path(spark, "whole")
    writers.write_whole(tables.documents(spark, sf_dir).select("text"), path)
    return _described(readers.read_whole(spark, path))


@query("SELECT DISTINCT source AS shard FROM documents")
def list_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.list_shards(tables.documents(spark, sf_dir))


@query("""
SELECT shard, row_number() OVER (ORDER BY shard) - 1 AS shard_rank, n_bytes FROM (
  SELECT source AS shard, sum(octet_length(encode(text)) + 1)::BIGINT AS n_bytes FROM documents GROUP BY source
  UNION ALL SELECT source || '-blank', 1 FROM (SELECT DISTINCT source FROM documents))""")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a folder with their sizes and ranks by name; every second one is a file of one line break.

    The folder's files hold documents as text, so that sizes are known.
    """
    docs, path = tables.documents(spark, sf_dir), new_path(spark, "listed")
    docs.select("shard", "text").write.partitionBy("shard").text(path)
    blank = docs.select(F.concat("shard", F.lit("-blank")).alias("shard")).distinct()
    blank.select("shard", F.lit("").alias("text")).write.mode("append").partitionBy("shard").text(path)
    found = readers.list_files(spark, path).withColumn("shard", F.regexp_extract("shard", "shard=([^/]+)/", 1))
    sizes = found.groupBy("shard").agg(F.sum("n_bytes").alias("n_bytes"))
    return splits.rank_shards(sizes.select("shard"), 0, 0).join(sizes, "shard").select("shard", F.col("shard_rank").cast("bigint").alias("shard_rank"), "n_bytes")


@query(f"WITH {VOCAB} SELECT token, id FROM vocab")
def vocab_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vocab-text")
    vocab = tables.vocab(spark, sf_dir)
    vocab.orderBy("id").select(F.concat_ws(" ", "token", "id")).write.text(path)
    return readers.read_vocab_lines(spark, path)


@query(f"WITH {VOCAB} SELECT token, id FROM vocab")
def vocab_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vocab-json")
    writers.write_vocab_json(tables.vocab(spark, sf_dir), path, per_file=100_000)
    return readers.read_vocab_json(spark, path)


@query("""
SELECT doc_id, lang, strftime(written, '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id % 2 = 1 THEN '.250000' ELSE '' END AS written,
       length(text) AS n_chars, md5(text) AS digest
FROM (SELECT *, TIMESTAMP '2021-04-11 00:00:00' + to_minutes(doc_id) AS written FROM documents)""")
def write_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zstandard JSON lines with metadata, times as ISO text; frames of the committed files are read in parallel."""
    docs = tables.documents(spark, sf_dir)
    micros = F.col("doc_id") * 60_000_000 + (F.col("doc_id") % 2) * 250_000
    written = F.timestamp_micros(F.unix_micros(F.lit("2021-04-11T00:00:00Z").cast("timestamp")) + micros)
    meta = F.to_json(F.struct("doc_id", "lang", writers.iso_timestamp(written).alias("written")))
    path = new_path(spark, "zstd")
    writers.write_jsonl(docs.select(writers.json_line("text", meta)), path, "zstd")
    back = readers.read_jsonl(spark, path, get_meta=True, framed=True)
    meta_of = lambda field: F.get_json_object("meta", f"$.{field}")
    return _described(
        back, meta_of("doc_id").cast("bigint").alias("doc_id"), meta_of("lang").alias("lang"), meta_of("written").alias("written")
    )


@query(f"""WITH {TOKENS} SELECT token, count(*) AS n
FROM (SELECT unnest(tokens) AS token FROM tokens) WHERE token <> '<eos>' GROUP BY token""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.word_counts(tables.documents(spark, sf_dir))


@query(f"WITH {VOCAB} SELECT token, id FROM vocab")
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.vocab(spark, sf_dir)
