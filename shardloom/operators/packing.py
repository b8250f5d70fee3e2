"""Fixed-length packing of token sequences.

Input: one row per document with scope columns, `chunk`, an order inside the chunk, the token array and
its length `n`. Tokens are never exploded one per row: a document is cut into at most n / L + 2 slices,
and the slices of a block meet in one small group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType
from pyspark.sql.window import Window as W

from shardloom.functions.arith import div
from shardloom.operators.prefix import prefix_agg

SEPARATOR = "\x1f"  # between tokens that move as one text


def offsets(docs: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Add `start`, the number of tokens before each document in its scope.

    Prefix sums at two scales: inside a chunk, and over chunk totals. The join on (scope, chunk) keeps
    the partitioning of the window, so the documents move once.
    """
    totals = docs.groupBy(*scope, "chunk").agg(F.sum("n").alias("_chunk_tokens"))
    totals = prefix_agg(totals, scope, "chunk", {"_chunk_start": ("sum", "_chunk_tokens")})
    window = W.partitionBy(*scope, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = docs.withColumn("_in_chunk", F.coalesce(F.sum("n").over(window), F.lit(0)))
    joined = inside.join(totals.drop("_chunk_tokens"), [*scope, "chunk"])
    return joined.withColumn("start", F.col("_chunk_start") + F.col("_in_chunk")).drop("_chunk_start", "_in_chunk")


def pack(
    docs: DataFrame,
    scope: list[str],
    order: list[str],
    length: int,
    tokens: str = "tokens",
    provenance: Column | None = None,
    keep_full_tail: bool = False,
    unfinished: bool = False,
) -> DataFrame:
    """Blocks of exactly `length` tokens across document borders.

    A block is emitted by the token after it, so T tokens give floor((T - 1) / L) blocks and the tail is
    dropped even when full (`keep_full_tail` keeps that one). `trigger` is the provenance of the document
    holding the token that emitted the block, null for a kept tail. `unfinished` returns the tail of every
    scope too, told apart by the column `emitted`.
    """
    return pack_placed(offsets(docs, scope, order), scope, length, tokens, provenance, keep_full_tail, unfinished)


def place_copies(docs: DataFrame, copies: DataFrame, key: list[str], tokens: str = "tokens") -> DataFrame:
    """Documents once for each place that `copies`, without tokens, has for their key: the tokens move once, not once a copy."""
    kept = [c for c in copies.columns if c not in key]
    places = copies.groupBy(*key).agg(F.collect_list(F.struct(*kept)).alias("_places"))
    return docs.select(*key, tokens).join(places, key).select(*key, tokens, F.inline("_places"))


def pack_placed(
    placed: DataFrame,
    scope: list[str],
    length: int,
    tokens: str = "tokens",
    provenance: Column | None = None,
    keep_full_tail: bool = False,
    unfinished: bool = False,
) -> DataFrame:
    """Blocks of documents whose `start` in their scope is known, as `offsets` gives it; the rest is as in `pack`."""
    provenance = F.lit(None).cast("string") if provenance is None else provenance
    placed = placed.filter("n > 0").select(*scope, "start", "n", F.col(tokens).alias("_tokens"), provenance.alias("_source"))
    start, end = F.col("start"), F.col("start") + F.col("n")
    first, last = div(start, length), div(end - 1, length)

    narrow, wide = _narrow(placed.schema["_tokens"].dataType)

    def piece(block: Column) -> Column:
        low, high = F.greatest(start, block * length), F.least(end, (block + 1) * length)
        part = narrow(F.slice("_tokens", (low - start + 1).cast("int"), (high - low).cast("int")))
        return F.struct(block.alias("block_no"), low.alias("low"), part.alias("part"), F.lit(False).alias("fires"))

    def trigger(block: Column) -> Column:
        """A document holding the first token of a block emits the block before it."""
        nothing = narrow(F.slice("_tokens", 1, 0))
        return F.struct(
            (block - 1).alias("block_no"), (block * length).alias("low"), nothing.alias("part"), F.lit(True).alias("fires")
        )

    spanned = F.sequence(first, last)
    fired = F.filter(spanned, lambda b: (b >= 1) & (b * length >= start))
    pieces = F.concat(F.transform(spanned, piece), F.transform(fired, trigger))
    slices = placed.select(*scope, "_source", F.inline(pieces))
    blocks = slices.groupBy(*scope, "block_no").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "part"))), lambda s: wide(s["part"]))).alias("tokens"),
        F.max(F.when(F.col("fires"), F.col("_source"))).alias("trigger"),
        F.max("fires").alias("emitted"),
    )
    if keep_full_tail:
        blocks = blocks.withColumn("emitted", F.col("emitted") | (F.size("tokens") == length))
    return blocks if unfinished else blocks.filter("emitted").drop("emitted")


def _narrow(kind: DataType) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """How a slice of tokens moves, and back: strings as one text, unless a null or the separator is among them."""
    if not isinstance(kind, ArrayType) or kind.elementType != StringType():
        return lambda part: part, lambda part: part

    def narrow(part: Column) -> Column:
        text = F.array_join(part, SEPARATOR, SEPARATOR)  # a null, like a separator inside a token, makes more pieces than tokens
        safe = (F.size(part) > 0) & (F.length(text) - F.length(F.replace(text, F.lit(SEPARATOR), F.lit(""))) == F.size(part) - 1)
        return F.struct(F.when(safe, text).alias("text"), F.when(~safe, part).alias("tokens"))

    return narrow, lambda part: F.coalesce(part["tokens"], F.split(part["text"], SEPARATOR, -1))


def triggers(docs: DataFrame, scope: list[str], order: list[str], length: int, provenance: Column) -> DataFrame:
    """Block provenance alone, from document lengths: no token array is read."""
    start, end = F.col("start"), F.col("start") + F.col("n")
    first, last = div(start + length - 1, length), div(end - 1, length)
    fired = F.filter(F.when(first <= last, F.sequence(first, last)), lambda q: q >= 1)
    placed = offsets(docs, scope, order).filter("n > 0")
    return placed.select(*scope, provenance.alias("trigger"), F.explode(fired).alias("_q")).select(
        *scope, (F.col("_q") - 1).alias("block_no"), "trigger"
    )


def count_blocks(docs: DataFrame, scope: list[str], length: int) -> DataFrame:
    """How many blocks each scope gives: floor((T - 1) / L), from token counts only."""
    total = F.sum("n")
    return docs.groupBy(*scope).agg(
        total.cast("bigint").alias("n_tokens"),
        F.greatest(div(total - 1, length), F.lit(0)).alias("n_blocks"),
    )


def tokens_seen(block_no: Column | str, length: int) -> Column:
    """Tokens consumed up to and including a block."""
    return ((F.col(block_no) if isinstance(block_no, str) else block_no) + 1) * length


def limit_tokens(blocks: DataFrame, length: int, token_limit: int = -1) -> DataFrame:
    """Blocks with their running token count; a positive limit keeps the blocks within it."""
    counted = blocks.withColumn("tokens_seen", tokens_seen("block_no", length))
    return counted.filter(F.col("tokens_seen") <= token_limit) if token_limit > 0 else counted
