"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets that are similar enough must share a token among the first few of each under any order of all tokens. The
orders used here are: tokens of one document first, then by hash, over the fifth of all tokens with the smallest hashes
(it drops the documents with little in common with others); then, over all tokens of the documents that are left, rare
ones first with ties broken by one hash, and by another. Pairs share a token under each order before their sets are
compared. Tokens are 64-bit hashes of shingles.

Copies are one node from the start. Of the other candidates only what connectivity needs is compared: first every token's
documents with the one that has the fewest tokens of its own, then all pairs that are not connected yet. Prefixes cannot tell
apart documents that have half of their tokens in common, so the second step also compares, inside its join, which of
PARITY_BITS groups of tokens have an odd number of members: two sets differ by at least as many tokens as they differ in
groups, so no link is lost. Beyond some 2,500 tokens a set that bound says less, and more pairs are compared whole.

Nulls: a null text is empty; an empty set links with nothing. Rows with a null doc_id are returned with a null component
and link with nothing. Rows that share a doc_id are one document with the links of all its texts. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import WORD, send
from shardloom.llm.components import components
from shardloom.session import stage

SHINGLE = 4
PERCENT = 85
LOW_PERCENT = 20  # share of tokens, those with the smallest hashes, that the first order counts
CHUNK = 1 << 20  # bytes hashed at a time
PARITY_BITS = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, _STEP))
_FAR = np.concatenate(([np.uint64(1)], np.cumprod(np.full((1 << 15) - 1, _POWERS[-1]))))  # powers for each 65,536 bytes of a word
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(width: int) -> np.ndarray:
    """Odd multipliers, another one for each place in a shingle."""
    return _mix(np.arange(1, width + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in bytes."""
    letter = ~_SPACE[data]
    starts = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    rest = data[starts[0] :]
    at = np.arange(len(rest)) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(data))))
    powers = _POWERS[at & 0xFFFF]
    if at.max() > 0xFFFF:
        powers = powers * _FAR[at >> 16]
    terms = np.where(letter[starts[0] :], rest.astype(np.uint64) + np.uint64(1), 0) * powers
    return _mix(np.add.reduceat(terms, starts - starts[0])), starts


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes (as signed longs) of each text's shingles; one of all words if there are fewer."""
    raws, places = [(t or "").encode().lower() for t in texts], _places(width)
    low = 0
    while low < len(raws):
        high, size = low + 1, len(raws[low])
        while high < len(raws) and size + len(raws[high]) <= CHUNK:
            size += len(raws[high])
            high += 1
        some = raws[low:high]
        words, starts = _words(np.frombuffer(b" ".join(some) + b" ", np.uint8))
        ends = np.cumsum([len(r) + 1 for r in some])
        cuts = np.concatenate(([0], np.searchsorted(starts, ends)))
        n = max(0, len(words) - width + 1)
        rows = _mix(sum(words[i : i + n] * places[i] for i in range(width))) if n else words[:0]
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if last - first >= width:
                own = rows[first : last - width + 1]
            elif last > first:
                few = words[first:last]
                own = _mix(np.array([(few * places[: len(few)]).sum() + np.uint64(last - first)], np.uint64))
            else:
                own = words[:0]
            yield np.unique(own.view(np.int64))
        low = high


def parities(tokens: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits as longs: whether an odd number of the tokens falls into a group."""
    odd = np.bincount(tokens & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def prefix_size(n: Column, percent: int) -> Column:
    """How many first tokens of a set of n must meet those of any set that is similar enough."""
    return n - F.ceil(n * percent / F.lit(100)).cast("int") + 1


def token_sets(docs: DataFrame, width: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, a 128-bit signature of the set, and its tokens: all with their parities, or the low ones and at least the first order's prefix."""
    send(__name__)
    border = np.int64(-(1 << 63) + (1 << 64) * LOW_PERCENT // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                sizes, signs, kept, odd = [], [], [], []
                for tokens in shingle_sets(part.column(1).to_pylist(), width):
                    n = len(tokens)
                    sizes.append(n)
                    signs.append(np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64))
                    least = n - -(-n * percent // 100) + 1 if n else 0
                    kept.append(tokens if whole else tokens[: max(least, int(np.searchsorted(tokens, border)))])
                    odd.append(parities(tokens) if whole else None)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept)))
                signs = np.stack(signs)
                arrays = [part.column(0), pa.array(sizes, pa.int32()), pa.array(signs[:, 0]), pa.array(signs[:, 1]), lists]
                arrays.append(pa.array(odd, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "s1", "s2", "tokens", "odd"])

    schema = "doc_id bigint, n int, s1 bigint, s2 bigint, tokens array<bigint>, odd array<bigint>"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def _shared(rows: DataFrame) -> DataFrame:
    """(token, node) rows whose token several nodes have, with their number; counts are pre-aggregated."""
    several = rows.groupBy("token").agg(F.count("*").cast("int").alias("df")).filter("df > 1")
    return rows.join(several, "token")


def _first(entries: Column, count: Column) -> Column:
    return F.transform(F.slice(F.array_sort(entries), 1, count), lambda e: e["token"])


def linked(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    This is connectivity only: pairs of documents that are connected already are not compared, so neither the links nor
    their number come out of it.
    """
    sets = stage(token_sets(docs, width, percent, whole=False), "low")
    narrow = sets.select("doc_id", "n", "s1", "s2")
    known = narrow.filter("doc_id is not null and n > 0")
    classes = stage(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "classes")

    # The first order: documents whose prefix is all their own link with nothing.
    nodes = sets.filter("n > 0").join(classes, ["s1", "s2"]).filter("doc_id = node")
    low = nodes.select(F.explode("tokens").alias("token"), "node")
    met = _shared(low).groupBy("node").agg(F.count("*").alias("met"))
    sized = nodes.select("node", "n", F.size("tokens").alias("n_low"))
    left = sized.join(met, "node").filter(F.col("n_low") - F.col("met") < prefix_size(F.col("n"), percent))
    left = stage(left.select("node").distinct(), "left")

    # The other orders: over all tokens of those that are left.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(left, F.col("doc_id") == F.col("node"))
    full = stage(token_sets(texts, width, percent, whole=True).withColumnRenamed("doc_id", "node"), "full")
    tokens = full.select(F.explode("tokens").alias("token"), "node")
    entry = lambda hashed: F.struct("df", hashed.alias("order"), "token")
    shared = _shared(tokens).groupBy("node").agg(
        F.count("*").cast("int").alias("met"),
        F.collect_list(entry(F.col("token"))).alias("one"),
        F.collect_list(F.xxhash64("token")).alias("hashes"),
    )
    own = F.col("n") - F.col("met")
    room = prefix_size(F.col("n"), percent) - own
    again = F.zip_with("one", "hashes", lambda e, h: F.struct(e["df"].alias("df"), h.alias("order"), e["token"].alias("token")))
    prefixes = (
        full.select("node", "n")
        .join(shared, "node")
        .filter(room > 0)
        .select("node", "n", own.alias("own"), _first(F.col("one"), room).alias("one"), _first(again, room).alias("two"))
    )
    prefixes = stage(prefixes, "prefixes")
    meetings = stage(prefixes.select(F.explode("one").alias("token"), "node", "n", "own"), "meetings")

    def similar_sizes(a: str, b: str) -> Column:
        common = F.least(F.col(f"{a}.n") - F.col(f"{a}.own"), F.col(f"{b}.n") - F.col(f"{b}.own"))
        union = F.greatest(F.col(f"{a}.n") + F.col(f"{b}.own"), F.col(f"{b}.n") + F.col(f"{a}.own"))
        return common * 100 >= union * percent

    def links(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that share a token under the second order too and whose sets are similar enough."""
        side = lambda x: full.join(prefixes.select("node", "two"), "node").select(
            F.col("node").alias(x), F.col("tokens").alias(f"{x}_set"), F.col("two").alias(f"{x}_two")
        )
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.arrays_overlap("a_two", "b_two"))
        same = F.size(F.array_intersect("a_set", "b_set"))
        return stage(both.filter(same * 100 >= (F.size("a_set") + F.size("b_set") - same) * percent).select("a", "b"), "links")

    # Every token's documents with the one that has the fewest tokens of its own.
    centre = meetings.groupBy("token").agg(F.min_by(F.struct("node", "n", "own"), F.struct("own", "node")).alias("c"))
    centre = centre.select("token", "c.*")
    stars = meetings.alias("x").join(centre.alias("c"), "token").filter(F.expr("x.node <> c.node") & similar_sizes("x", "c"))
    stars = stage(stars.select(F.least("x.node", "c.node").alias("a"), F.greatest("x.node", "c.node").alias("b")).distinct(), "stars")
    first = links(stars)

    # All other pairs that meet and are not connected yet.
    found = stage(components(first), "found")
    placed = meetings.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    placed = placed.join(split.filter("least <> most").select("token"), "token")
    odd = full.select("node", *[F.col("odd")[i].alias(f"odd{i}") for i in range(PARITY_BITS // 64)])
    placed = stage(placed.join(odd, "node"), "placed")
    x, y = placed.alias("x"), placed.alias("y")
    apart = sum((F.bit_count(F.col(f"x.odd{i}").bitwiseXOR(F.col(f"y.odd{i}"))) for i in range(PARITY_BITS // 64)), F.lit(0))
    close = apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)  # the most tokens that linked sets differ by
    rest = x.join(y, F.expr("x.token = y.token and x.node < y.node and x.component <> y.component") & similar_sizes("x", "y") & close)
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    second = links(stage(rest, "rest"))

    found = stage(components(first.union(second)), "found")
    owner = classes.join(found, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    return narrow.join(owner, ["s1", "s2"], "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without all but the first of each component, with all their columns.

    Of rows that share a doc_id the one with the smallest text (by its digest) stays, of rows without a doc_id one for each
    text that has a word.
    """
    found = linked(docs, width, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    given = F.struct(*[F.col(c) for c in docs.columns]).alias("_given")  # so that no name of theirs meets one of ours
    digest = F.sha2(F.col("text").cast("binary"), 256)
    nameless = F.col("doc_id").isNull() & F.col("text").rlike(WORD)
    rows = docs.select(
        given, F.col("doc_id").cast("bigint").alias("_id"), F.when(nameless, digest).alias("_text"), (F.col("doc_id").isNotNull() | nameless).alias("_one")
    )
    rows = rows.join(stage(found, "gone"), F.col("_id") == F.col("_gone"), "left_anti")
    # Rows are rarely repeated: only those that are meet their like, each with its digest.
    keys = rows.filter("_one").groupBy("_id", "_text").agg(F.count("*").alias("_n")).filter("_n > 1")
    keys = stage(keys.select(F.col("_id").alias("_same_id"), F.col("_text").alias("_same_text")), "repeated")
    same = F.expr("_one and _id <=> _same_id and _text <=> _same_text")
    text = F.sha2(F.col("_given")["text"].cast("binary"), 256)
    first = rows.join(keys, same, "left_semi").groupBy("_id", "_text").agg(F.min_by("_given", F.coalesce(text, F.lit(""))).alias("_given"))
    return rows.join(keys, same, "left_anti").select("_given").unionByName(first.select("_given")).select("_given.*")
