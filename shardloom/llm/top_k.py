"""Exact top-k inner products by the threshold algorithm over sorted lists, one list per dimension.

Vectors are dealt into blocks of bounded size and queries into chunks; every block meets every chunk once, the chunk's
queries read the block's lists from their best ends, and a query stops when the sum of what the lists can still give
cannot beat its k-th score. The best k of all blocks are then ranked; no block's result is more than k rows a query.

Nulls: vectors that are null, or hold null or non-finite components, and rows with a null id take no part. Only vectors
of one length meet. Rows with the query's id are its own and are no candidates; other repeated rows are candidates of
their own. Queries with the same id and quantized vector are one query and answer once; different vectors under one id are
queries of their own, and each has its own ranks under that id. Components are floor(256 * x); scores beyond a long stop at its ends. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shardloom.llm.common import send

BLOCK_ROWS = 4_096  # vectors that a task sorts at a time
CHUNK_ROWS = 2_048  # queries that meet a block together
FIRST_DEPTH = 8  # list entries read before the bound is first looked at; the depth then doubles
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def quantized(embedding: Column) -> Column:
    """floor(256 * x) of each component, or null for a vector that takes no part."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * 256).cast("bigint")))


class Lists:
    """The rows of a block in ascending order of each component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.largest = float(np.abs(self.rows.astype(np.float64)).max(initial=0.0))
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.sort(self.rows, axis=0).T
        self.float_rows = self.rows.astype(np.float64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The best k of (vec_id, score), by score, then smaller id. Only the parts of the lists that are read are touched."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        exact = self.largest * float(np.abs(query.astype(np.float64)).sum()) < EXACT
        kind = np.float64 if exact else object
        rows, asked = (self.float_rows if exact else self.rows.astype(object)), query.astype(kind)
        rising, falling = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen, left = np.zeros(n, bool), n
        best: list[tuple[int, int]] = []  # (-score, row); rows are in id order
        low, high = 0, FIRST_DEPTH
        while low < n:
            high = min(high, n) if len(used) else n
            read = np.full(n, not len(used))
            read[self.order[rising, n - high : n - low]] = True
            read[self.order[falling, low:high]] = True
            new = np.flatnonzero(read & ~seen)
            seen[new] = True
            left -= len(new)
            # A product with all rows costs less than a copy of many; what was not read is left out of it.
            scores = (rows @ asked)[new] if exact and 4 * len(new) > n else rows[new] @ asked
            other = self.ids[new] != query_id  # before the cuts below, which copies of the query's own rows could fill
            if len(best) == k:
                other &= scores >= -best[-1][0]
            new, scores = new[other], scores[other]
            if exact and len(new) > 4 * k:  # all that could be among the best k
                floor = np.partition(scores, len(scores) - 2 * k)[len(scores) - 2 * k]
                chosen = np.union1d(np.flatnonzero(scores > floor), np.flatnonzero(scores == floor)[: 2 * k])
            else:
                chosen = np.arange(len(new))
            best = sorted(best + [(-int(scores[i]), int(new[i])) for i in chosen])[:k]
            if not left:
                break
            if len(best) == k:
                ends = np.concatenate((self.values[rising, n - high], self.values[falling, high - 1])).astype(kind)
                if -best[-1][0] > int((ends * asked[np.concatenate((rising, falling))]).sum()):
                    break
            low, high = high, 2 * high
        return [(int(self.ids[row]), max(LONG[0], min(LONG[1], -score))) for score, row in best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors(vec_id, embedding) and queries(vec_id, embedding) to query_id, rank, vec_id, score."""
    ready = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantized(F.col("embedding")).alias("v")).filter(
        "vec_id is not null and v is not null"
    )
    vectors, queries = ready(vectors), ready(queries).distinct()
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    chunks = max(1, -(-queries.count() // CHUNK_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("*", F.size("v").alias("d"), dealt(blocks).alias("block"), to_all(chunks).alias("chunk"))
    right = queries.select("*", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256).alias("asked"), F.size("v").alias("d"), dealt(chunks).alias("chunk"), to_all(blocks).alias("block"))
    send(__name__)
    result = pa.schema([("query_id", pa.int64()), ("asked", pa.string()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, str, int, int]] = []
        if len(left) and len(right):
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), key[0].as_py())
            lists = Lists(left["vec_id"].to_numpy(), matrix(left))
            for query_id, asked, query in zip(right["vec_id"].to_pylist(), right["asked"].to_pylist(), matrix(right), strict=True):
                rows += [(query_id, asked, *found) for found in lists.search(query_id, query, k)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, field.type) for c, field in zip(columns, result, strict=True)], result)

    by = ["d", "block", "chunk"]
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id bigint, asked string, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
