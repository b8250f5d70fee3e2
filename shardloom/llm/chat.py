"""Chat formatting with Spark expressions only.

A conversation becomes one string. Adjacent turns of one role share a block:

    <s>user[INST]first text<sep>second text</s><s>assistant[/INST]answer</s>

`[/INST]` opens a block that the loss covers, `[INST]` any other. A control string inside a text gets a backslash
after its first character, and one more if it has some already, so reading back takes exactly one away.

Nulls: a null text or role is empty, a null turn comes first, rows with a null conv_id are one conversation. Turns
with equal numbers are ordered by role, then text; repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shardloom.llm.common import sha256_hex

_REST = r"(?:/?s>|sep>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*" + _REST + ")", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*" + _REST + ")", "$1$2")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, text) to conv_id, formatted, and the loss mask: spans of code points, end exclusive.

    All turns of a conversation meet in one row because the result is one string; offsets are running sums, so
    the work is linear in its length.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    of = lambda i: F.get("_turns", i)["role"]

    def piece(t: Column, i: Column) -> Column:
        opens = F.when(t["role"] == F.lit(loss_role), "[/INST]").otherwise("[INST]")
        follows = (i > 0) & F.coalesce(of(i - 1) == t["role"], F.lit(False))
        head = F.when(follows, F.lit("<sep>")).otherwise(F.concat(F.lit("<s>"), escape(t["role"]), opens))
        last = ~F.coalesce(of(i + 1) == t["role"], F.lit(False))
        return F.struct(
            head.alias("head"),
            escape(t["text"]).alias("body"),
            F.when(last, F.lit("</s>")).otherwise("").alias("tail"),
            (t["role"] == F.lit(loss_role)).alias("loss"),
        )

    pieces = sorted_turns.select("conv_id", F.posexplode(F.transform("_turns", piece)).alias("_at", "_piece"))
    pieces = pieces.select("conv_id", "_at", "_piece.*")
    before = W.partitionBy("conv_id").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.length("tail")
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    placed = pieces.withColumn("start", start.cast("bigint")).withColumn("end", F.col("start") + F.length("body"))
    rows = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("_at", "head", "body", "tail", "loss", "start", "end"))).alias("_pieces")
    )
    return rows.select(
        "conv_id",
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.transform(
            F.filter("_pieces", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))
        ).alias("loss_mask"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Back from format_chats' output: its columns and the turns, array<struct<role, text>>."""
    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, 4, F.length(block)), r"\[/?INST\]", 2)
        role = unescape(F.get(parts, F.lit(0)))
        return F.transform(
            F.split(F.get(parts, F.lit(1)), "<sep>", -1), lambda text: F.struct(role.alias("role"), unescape(text).alias("text"))
        )

    return formatted.withColumn("n_blocks", F.size(blocks)).withColumn("turns", F.flatten(F.transform(blocks, turns)))


def chat_digest(turns: DataFrame) -> DataFrame:
    """Digests of every conversation, taken from the formatted string and the mask alone."""
    masked = F.transform(
        "loss_mask",
        lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read_chats(format_chats(turns)).withColumn("_loss", F.array_join(masked, ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        sha256_hex(F.array_join(said, "")).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        sha256_hex(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.col("n_blocks").cast("bigint").alias("n_blocks"),
    )
