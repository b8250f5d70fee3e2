"""Packing of documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardloom.functions.arith import div
from shardloom.operators.lookup import attach
from shardloom.operators.packing import pack
from shardloom.session import STORED_AS


def pack_stream(
    docs: DataFrame, out: str, progress: str, length: int, scope: list[str], chunk_docs: int = 20_000
) -> StreamingQuery:
    """Pack each micro-batch behind the unfinished block that the batch before it left in every scope.

    `docs` streams scope columns, doc_no (rising over arrivals within a scope), tokens and n. A micro-batch
    is packed by the batch operator, so even one hot scope spreads over many tasks. What passes from batch
    to batch is one unfinished block of at most `length` tokens per scope, stored beside the finished ones
    as emitted = false. A batch that is run again rewrites its own folder, so blocks appear once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        carried = _unfinished(batch, f"{out}/batch={batch_id - 1}" if batch_id else None, scope)
        fresh = batch.select(*scope, (div("doc_no", chunk_docs) + 1).alias("chunk"), "doc_no", "tokens")
        head = carried.select(
            *scope, F.lit(0).cast("bigint").alias("chunk"), F.lit(-1).cast("bigint").alias("doc_no"), "tokens"
        )
        rows = head.unionByName(fresh).withColumn("n", F.size("tokens").cast("bigint"))
        blocks = pack(rows, scope, ["doc_no"], length, provenance=F.col("doc_no"), unfinished=True)
        first = carried.select(*scope, F.col("block_no").alias("first"))
        blocks = attach(blocks, scope, first, F.col("block_no"))
        numbered = blocks.withColumn("block_no", F.col("block_no") + F.coalesce("first", F.lit(0))).drop("first")
        numbered.write.mode("overwrite").partitionBy("emitted").parquet(f"{out}/batch={batch_id}", compression=STORED_AS)

    return (
        docs.writeStream.foreachBatch(run)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def read_packed(spark: SparkSession, out: str) -> DataFrame:
    """The finished blocks of all micro-batches so far."""
    return spark.read.parquet(out).filter("emitted = 'true'").drop("batch", "emitted")


def _unfinished(batch: DataFrame, folder: str | None, scope: list[str]) -> DataFrame:
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in batch.select(*scope, "tokens").schema]
    schema = ", ".join([*columns, "block_no bigint", "emitted boolean"])
    if folder is None:
        return batch.sparkSession.createDataFrame([], schema)
    return batch.sparkSession.read.schema(schema).parquet(folder).filter("not emitted")
