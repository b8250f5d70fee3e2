"""Token ids as binary containers with a shared zstandard dictionary.

A container is one file image: a magic word, the hash of the dictionary, an index and the documents' ids (little-endian
unsigned 32-bit integers), each document compressed on its own. A document is read with the index and its own frame
alone. Containers are rows of a table, because only Spark's writers reach every store and commit tasks that are repeated;
the dictionary is a row of a table beside it.

    b"TOKS0001" | 32 bytes sha-256 of the dictionary | n documents | n x (doc_id, end of frame, n_tokens) | frames

Documents are in ascending doc_id order over all containers, null first; rows with one doc_id follow each other by the hash
of their text. A null text is an empty one: its end id alone. An empty table gives no container and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from shardloom.llm.common import once, send, tokenizer_file
from shardloom.session import new_path, stage

VOCABULARY = "word_bpe_49k.json"
END = 2
MAGIC = b"TOKS0001"
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("end", "<u8"), ("n", "<u8")])
CONTAINER_BYTES = 8 << 20  # of compressed ids, about
#: The dictionary is trained on the ids of so many documents, those with the smallest hashed ids, and so many bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16 << 10, 64 << 10
REMEMBERED = 250_000  # runs, and pieces, in each generation of a process's cache
TOGETHER, TOGETHER_CHARS = 256, 1 << 20  # most texts, and characters unless one text has more, encoded in one call
CONTAINER = "part int, first bigint, n_docs bigint, n_tokens bigint, image binary"


class Remembered(dict):
    """A bounded cache of two generations: what is used stays, and nothing but speed depends on it."""

    def __init__(self, most: int = REMEMBERED):
        super().__init__()
        self.older: dict = {}
        self.most = most

    def __missing__(self, key):
        self[key] = value = self.older[key]
        return value

    def new(self, keys: set) -> set:
        return set(filterfalse(self.older.__contains__, filterfalse(self.__contains__, keys)))

    def room(self) -> None:
        """To be called between uses: the younger generation grows old."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


#: This vocabulary's splitter for text up to U+00FF, after lower-casing, where its normaliser changes nothing else (fixed values).
_LETTER, _NUMBER, _BLANK = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "[\u0085\u00a0]"
#: Whatever is not a run of letters; ASCII white space is cut at later, and _BLANK is made a space before.
_APART = f"('s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^\t\n\x0b\f\r {_LETTER}{_NUMBER}]+)"


def _plain(text: str) -> bool:
    """Whether the rules above make the pieces that the library would make: nothing above U+00FF, no special token."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return "<|" not in text


class WordEncoder:
    """Whole texts to their ids as bytes, by the tokenizers library.

    Plain texts are split by Arrow into the pieces that the library would make of them, some hundreds of texts at a time, and
    their distinct pieces are looked up. Only new pieces go to the library, many in one call: each gives exactly one token that
    ends a word. This vocabulary's normaliser and splitter never join what ASCII white space parts, so of other texts each run
    goes to the library as it is, once.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.ready = Tokenizer.from_file(path)  # for pieces, which its normaliser and splitter would leave as they are
        self.ready.normalizer = None
        self.ready.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces, self.runs = Remembered(), Remembered()
        words = self.library.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for word, i in words.items() if word.endswith("</w>")]] = True

    def _learn_pieces(self, new: list[str]) -> None:
        made = self.ready.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0]  # without offsets
        ids = np.array(made.ids, "<u4")
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        raw, starts = ids.tobytes(), [0, *stops[:-1]]
        self.pieces.update((piece, raw[i:j]) for piece, i, j in zip(new, starts, stops, strict=True))

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        spaced = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), _BLANK, " ")
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(spaced, _APART, r" \1 "))
        flat = split.flatten().dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # as strings, faster than to_pylist
        self.pieces.room()
        self.pieces[""] = b""  # where a text begins or ends with white space
        if unknown := self.pieces.new(set(distinct)):
            self._learn_pieces(list(unknown))
        coded = list(map(self.pieces.__getitem__, distinct))
        ids, sizes = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        places = flat.indices.to_numpy()
        n = sizes[places]
        ends = np.cumsum(n)
        jumps = (np.cumsum(sizes) - sizes)[places] - (ends - n)  # from where an id stands in the result to where it is known
        made = ids[np.repeat(jumps, n) + np.arange(ends[-1] if len(ends) else 0)]
        borders = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))]
        return [made[i:j].tobytes() for i, j in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]

    def _encode_runs(self, text: str) -> bytes:
        runs = [run.decode() for run in text.encode().split()]
        self.runs.room()
        new = list(self.runs.new(set(runs)))
        for run, made in zip(new, self.library.encode_batch(new, add_special_tokens=False), strict=True):
            self.runs[run] = np.array(made.ids, "<u4").tobytes()
        return b"".join(map(self.runs.__getitem__, runs))

    def encode(self, texts: list[str], end: int = END) -> list[bytes]:
        """Ids of each text, with the end id, as little-endian 32-bit integers."""
        made: list[bytes] = [b""] * len(texts)
        some, size, last = [], 0, struct.pack("<I", end)

        def finish() -> None:
            for i, ids in zip(some, self._encode_plain([texts[i] for i in some]) if some else (), strict=True):
                made[i] = ids + last

        for i, text in enumerate(texts):
            if not _plain(text):
                made[i] = self._encode_runs(text) + last
                continue
            if size + len(text) > TOGETHER_CHARS:
                finish()
                some, size = [], 0
            some.append(i)
            size += len(text)
        finish()
        return made


def _encoder(path: str) -> WordEncoder:
    return once(("word_bpe", path), lambda: WordEncoder(path))


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary for zstandard from a bounded sample of encoded documents; empty if there are too few."""
    send(__name__)
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("_sampled"))
    ids = ids.orderBy(F.xxhash64("_sampled"), "_sampled").limit(SAMPLE_ROWS).distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_sampled")).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tool = _encoder(path)
            made = [ids[:SAMPLE_BYTES] for t in batch.column(1) for ids in tool.encode([t.as_py() or ""])]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["ids"])

    samples = sorted(bytes(r.ids) for r in sample.mapInArrow(encode, "ids binary").limit(2 * SAMPLE_ROWS).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compression(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def pack(entries: list[tuple[int | None, int]], frames: list[bytes], dictionary: bytes) -> bytes:
    """A container image from (doc_id, n_tokens) and compressed ids."""
    index = np.zeros(len(entries), ENTRY)
    index["doc_id"] = [e[0] or 0 for e in entries]
    index["null"] = [e[0] is None for e in entries]
    index["end"] = np.cumsum([len(f) for f in frames])
    index["n"] = [e[1] for e in entries]
    head = MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<Q", len(entries))
    return head + index.tobytes() + b"".join(frames)


class Container:
    """Reads single documents of an image."""

    def __init__(self, image: bytes, dictionary: bytes):
        if image[:8] != MAGIC or image[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a container, or one written with another dictionary")
        (n,) = struct.unpack_from("<Q", image, 40)
        self.index = np.frombuffer(image, ENTRY, n, 48)
        self.frames = 48 + n * ENTRY.itemsize
        self.image = image
        self.reader = zstandard.ZstdDecompressor(**_compression(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> bytes:
        first = int(self.index["end"][i - 1]) if i else 0
        return self.reader.decompress(self.image[self.frames + first : self.frames + int(self.index["end"][i])])


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode whole texts and write containers and the dictionary under `folder`.

    Texts are ranged over doc_id, so parts are in order and of like size; inside a part they are sorted and encoded
    one after another, and a container is emitted whenever it is full, so a task holds one container at a time.
    """
    path = path or tokenizer_file(VOCABULARY)
    dictionary = train_dictionary(docs, path)
    send(__name__)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _encoder(path)
        writer = zstandard.ZstdCompressor(level=3, **_compression(dictionary))
        entries, frames, size, first = [], [], 0, 0
        part = 0

        def full() -> pa.RecordBatch:
            n = sum(e[1] for e in entries)
            row = {"part": part, "first": first, "n_docs": len(entries), "n_tokens": n, "image": pack(entries, frames, dictionary)}
            kinds = [("part", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())]
            return pa.RecordBatch.from_pylist([row], pa.schema(kinds))

        for batch in batches:
            for low in range(0, len(batch), TOGETHER):
                some = batch.slice(low, TOGETHER)
                part = some.column(0)[0].as_py()
                encoded = tool.encode([t or "" for t in some.column(2).to_pylist()])
                for doc_id, ids in zip(some.column(1).to_pylist(), encoded, strict=True):
                    entries.append((doc_id, len(ids) // 4))
                    frames.append(writer.compress(ids))
                    size += len(frames[-1])
                    if size >= CONTAINER_BYTES:
                        yield full()
                        first += len(entries)
                        entries, frames, size = [], [], 0
        if entries:
            yield full()

    placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id(), "doc_id", "text")
    placed.mapInArrow(encode, CONTAINER).write.option("compression", "uncompressed").parquet(f"{folder}/containers")
    spark = docs.sparkSession
    spark.range(1).select(F.lit(dictionary).alias("dictionary")).write.parquet(f"{folder}/dictionary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents under `folder`.

    start counts the ids of all documents before: sums over the parts, then over a part's containers, then an index.
    """
    send(__name__)
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first().dictionary)
    files = spark.read.parquet(f"{folder}/containers")
    sizes = files.select("part", "first", "n_tokens")
    before = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before([], "part")), F.lit(0)).alias("earlier"))
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before(["part"], "first")), F.lit(0)))
    starts = starts.join(parts, "part").select("part", "first", (F.col("earlier") + F.col("inside")).alias("start"))
    starts = stage(starts, "starts")  # its size is known then, and the images stay where they are while it is small

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, image in zip(batch.column(0), batch.column(1), strict=True):
                held = Container(image.as_py(), dictionary)
                begins = start.as_py() + np.concatenate(([0], np.cumsum(held.index["n"])))
                for low in range(0, len(held), 1000):
                    some = held.index[low : low + 1000]
                    arrays = [
                        pa.array(some["doc_id"], mask=some["null"] > 0),
                        pa.array(begins[low : low + len(some)].astype(np.int64)),
                        pa.array(some["n"].astype(np.int64)),
                        pa.array([held.ids(i) for i in range(low, low + len(some))], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])

    joined = files.select("part", "first", "image").join(starts, ["part", "first"]).select("start", "image")
    return joined.mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def stored_digest(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Write the documents' ids, read the files back, and check-sum what was read."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    write(docs, folder, path)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
