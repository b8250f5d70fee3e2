"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string is known when the last token of each of its prefixes is: it is the one token that ends
there and that stands, as BPE merges, beside the last token of the prefix before it. Such a table can be appended to
exactly, and after an edit only a stretch about as long as the longest token has to be computed anew.

Nulls: a null text is an empty one, with no tokens. Rows that repeat are encoded alike, null doc_ids are kept, an empty
table gives no rows. Long texts and long pieces cost linear time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shardloom.llm.common import byte_ranks, once, send, tokenizer_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Most pieces, and most pairs of tokens, that a process remembers; only speed depends on it.
REMEMBERED = 500_000
TOGETHER = 64  # texts whose ids are held at a time
NEVER = 1 << 62


class Vocabulary:
    """Ranks of byte strings, and which two tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.remembered: dict[tuple[int, int], bool] = {}
        self.grown: dict[int, tuple[list, list, bool]] = {}

    def merged(self, text: bytes, parts_left: int = 1) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals; used on one or two tokens only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > parts_left:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _spines(self, token: int) -> tuple[list, list, bool]:
        """How the token's first and last parts grow as it is merged: for each its bytes and the rank that swallows it.

        The third value tells whether ranks rise on the way, as in a vocabulary that merging has built.
        """
        found = self.grown.get(token)
        if found is None:
            text, sides, regular = self.tokens[token], ([], []), True
            for side, spine in enumerate(sides):
                part, swallowed = text, NEVER
                while True:
                    spine.append((part, swallowed))
                    regular = regular and self.ranks[part] < swallowed
                    if len(part) == 1:
                        break
                    halves = self.merged(part, 2)
                    if len(halves) != 2:
                        regular = False
                        break
                    swallowed = self.ranks[part]
                    part = self.tokens[halves[side]]
                spine.reverse()
            found = self.grown[token] = (*sides, regular)
        return found

    def stands(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives both again; left -1: whether right alone does."""
        known = self.remembered.get((left, right))
        if known is None:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            known = self.remembered[left, right] = self._stands(left, right)
        return known

    def _stands(self, left: int, right: int) -> bool:
        if left < 0:
            return self.merged(self.tokens[right]) == [right]
        _, ends, regular = self._spines(left)
        begins, _, also = self._spines(right)
        if not (regular and also):
            return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        # The parts that meet at the border in the course of merging; a token across it must never be next.
        i = j = 0
        while True:
            (a, a_goes), (b, b_goes) = ends[i], begins[j]
            across = self.ranks.get(a + b)
            if across is not None and across < a_goes and across <= b_goes:
                return False
            if a_goes == b_goes == NEVER:
                return True
            if a_goes <= b_goes:
                i += 1
            else:
                j += 1


class PrefixTokens:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def _extend(self, upto: int) -> None:
        """Last tokens up to this prefix. Only one token can be right, so the usual lengths, the short ones, come first."""
        text, last, ranks, remembered = self.text, self.last, self.vocabulary.ranks, self.vocabulary.remembered
        for end in range(len(last) + 1, upto + 1):
            for start in range(end - 1, max(-1, end - self.vocabulary.longest - 1), -1):
                token = ranks.get(text[start:end])
                if token is not None:
                    before = last[start - 1] if start else -1
                    stands = remembered.get((before, token))
                    if stands or stands is None and self.vocabulary.stands(before, token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"the vocabulary lacks byte {text[end - 1]}")

    def append(self, more: bytes) -> None:
        self.text += more
        self._extend(len(self.text))

    def replace(self, start: int, stop: int, other: bytes) -> int:
        """Put `other` in place of text[start:stop]; returns how many last tokens were computed anew.

        The table is kept up to the edit. Behind it, computing goes on until as many last tokens in a row as the
        longest token has bytes are what they were: from there on nothing differs.
        """
        old, moved = self.last, len(other) - (stop - start)
        self.text = self.text[:start] + other + self.text[stop:]
        self.last = old[:start]
        alike, first = 0, start + len(other)
        for end in range(start + 1, len(self.text) + 1):
            self._extend(end)
            if end > first:
                alike = alike + 1 if self.last[-1] == old[end - 1 - moved] else 0
                if alike >= self.vocabulary.longest:
                    self.last += old[end - moved :]
                    return end - start
        return len(self.text) - start

    def ids(self) -> list[int]:
        found, end = [], len(self.text)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[found[-1]])
        return found[::-1]


class Encoder(dict):
    """Pieces to their ids as decimal text; a piece that is a token is that token."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = Vocabulary(byte_ranks(path))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.decimal = {str(rank): token for rank, token in self.vocabulary.tokens.items()}

    def __missing__(self, piece: str) -> str:
        raw = piece.encode()
        whole = self.vocabulary.ranks.get(raw)
        ids = [whole] if whole is not None else PrefixTokens(self.vocabulary, raw).ids()
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = found = ",".join(map(str, ids))
        return found

    def encode(self, text: str) -> str:
        return ",".join([self[piece] for piece in self.split(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.decimal.__getitem__, ids.split(","))) if ids else b""


def _map(docs: DataFrame, schema: str, columns: Callable[[Encoder, list[str]], list[pa.Array]], path: str | None) -> DataFrame:
    """doc_id with what `columns` makes of a few texts at a time, so a task never holds the ids of a whole batch."""
    send(__name__)
    path = path or tokenizer_file(VOCABULARY)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = once(("byte_bpe", path), lambda: Encoder(path))
        for batch in batches:
            for low in range(0, len(batch), TOGETHER):
                some = batch.slice(low, TOGETHER)
                made = columns(tool, [text or "" for text in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), *made], names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def _ids(tool: Encoder, texts: list[str]) -> list[pa.Array]:
    found = [np.fromstring(ids, np.int32, sep=",") if ids else np.empty(0, np.int32) for ids in map(tool.encode, texts)]
    offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in found]))).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))]


def _digest(tool: Encoder, texts: list[str]) -> list[pa.Array]:
    n, ids_digests, text_digests = [], [], []
    for ids in map(tool.encode, texts):
        n.append(ids.count(",") + 1 if ids else 0)
        ids_digests.append(hashlib.sha256(ids.encode()).hexdigest())
        text_digests.append(hashlib.sha256(tool.decode(ids)).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each text; nothing is shuffled."""
    return _map(docs, "doc_id bigint, ids array<int>", _ids, path)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode whole texts and decode the ids: token counts and digests of both."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _map(docs, schema, _digest, path)
