"""Documents packed whole into as few sequences of a fixed number of tokens as an online rule can do it with.

Every text is encoded where it is read and becomes pieces: one, or for a longer document several of full length and a rest.
Only the pieces' lengths and check sums move. They are dealt out by a hash and packed in hash order, in windows that are sorted by
falling length, with a fixed number of open bins. The open bins are found by a bitset with one bit per free space: a piece goes
to the bin with the least space that takes it; if none does, a bin is opened, and when all are open the fullest closes first.
A task holds its open bins (two numbers each) and one window of pieces, whatever it reads, and gives each piece's sequence and
offset at once. The number of tasks follows from the number of tokens, so that the last, partly filled bins of each do not count.

Nulls: a null text is empty, one piece of the closing id alone; a null doc_id is kept. Rows that repeat are packed each on its
own. Very long texts are cut at the sequence's length, never shortened. An empty table gives no rows. Further columns go unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import once, send, tokenizer_file
from shardloom.llm.token_files import TOGETHER, VOCABULARY, WordEncoder
from shardloom.session import stage

LENGTH = 2048  # tokens of a sequence
END = 0
OPEN = 2048  # bins open at a time
WINDOW = 2_048  # pieces sorted by falling length; not more than OPEN, or a window closes bins that its small pieces would fill
TASK_TOKENS = 4 << 20  # a task's share, about
PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def _table(columns: list, names: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, names, strict=True)], [n for n, _ in names])


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of what every text is cut into."""
    path = path or tokenizer_file(VOCABULARY)
    send(__name__)
    send(WordEncoder.__module__)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = once(("word_bpe", path), lambda: WordEncoder(path))
        for batch in batches:
            for low in range(0, len(batch), TOGETHER):
                some = batch.slice(low, TOGETHER)
                rows = []
                encoded = tool.encode([t or "" for t in some.column(1).to_pylist()], END)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoded, strict=True):
                    parts = [ids[i : i + 4 * length] for i in range(0, len(ids), 4 * length)]
                    rows += [(doc_id, k, k * length, len(part) // 4, zlib.crc32(part)) for k, part in enumerate(parts)]
                yield _table(list(zip(*rows, strict=True)), PIECES)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, kinds)


class Bins:
    """Open bins by their free space."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, least: int) -> tuple[int, int]:
        """The bin with the least free space of at least `least`, and that space; space 0 if there is none."""
        fitting = self.bits >> least
        if not fitting:
            return 0, 0
        space = least + (fitting & -fitting).bit_length() - 1
        stack = self.by_space[space]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << space
        self.open -= 1
        return found, space

    def place(self, size: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        found, space = self._take(size)
        if not space:
            if self.open == self.most:
                self._take(1)  # the fullest closes
            found, space = self.made, self.length
            self.made += 1
        rest = space - size
        if rest:
            self.by_space[rest].append(found)
            self.bits |= 1 << rest
            self.open += 1
        return found, self.length - space


def pack(placed: DataFrame, length: int = LENGTH, most_open: int = OPEN, window: int = WINDOW, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces (written before: they are read twice, and a repeated task must find the same rows)."""
    tokens = placed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    send(__name__)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, waiting, held = Bins(length, most_open), [], 0

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            sizes = rows["length"].to_numpy()
            order = np.argsort(-sizes, kind="stable")
            put = np.empty((len(sizes), 2), np.int64)
            put[order] = [bins.place(size) for size in sizes[order].tolist()]
            first = np.int64(rows["task"][0].as_py()) << 40
            made = rows.select(columns).append_column("sequence_id", pa.array(put[:, 0] + first)).append_column("offset", pa.array(put[:, 1]))
            return made.to_batches()[0]

        for batch in batches:
            for low in range(0, len(batch), window):
                waiting.append(batch.slice(low, window))
                held += len(waiting[-1])
                if held >= window:
                    yield packed()
                    waiting, held = [], 0
        if held:
            yield packed()

    tied = placed.select(*columns, F.monotonically_increasing_id().alias("tie"))
    dealt = tied.repartition(int(tokens // task_tokens) + 1, F.xxhash64("tie")).sortWithinPartitions(F.xxhash64("tie"), "tie")
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return dealt.select(*columns, F.spark_partition_id().alias("task")).mapInArrow(fill, kinds)


def best_fit(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    return pack(stage(pieces(docs, length, path), "pieces"), length)
