"""Writers for documents and vocabularies."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from shardloom.functions.arith import div
from shardloom.session import qualified, ship
from shardloom.sources import frames

ZSTD_LEVEL = 3
FRAME_BYTES = 4 << 20  # of text, about


def iso_timestamp(ts: Column | str) -> Column:
    """ISO 8601 text; the fraction appears only when there is one."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", ts) == ts, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def json_line(text: Column | str, meta: Column | None = None) -> Column:
    """The `{"text": ..., "meta": {...}}` line of a document; `meta` is JSON text."""
    text = F.col(text) if isinstance(text, str) else text
    meta = F.lit("{}") if meta is None else F.coalesce(meta, F.lit("{}"))
    return F.to_json(F.struct(text.alias("text"), F.parse_json(meta).alias("meta")))


def write_jsonl(lines: DataFrame, path: str, compression: str = "zstd", frame_bytes: int = FRAME_BYTES) -> None:
    """Append a one-column DataFrame of JSON lines as compressed files under `path`.

    Spark's text writer has no zstd codec, so that one goes through the `zstd_lines` writer below.
    """
    if compression == "zstd":
        ship(__name__)
        ship(frames.__name__)
        lines.sparkSession.dataSource.register(ZstdLines)
        options = {"frame_bytes": frame_bytes, "path": qualified(lines.sparkSession, path)}
        lines.toDF("value").write.format("zstd_lines").options(**options).mode("append").save()
    else:
        lines.toDF("value").write.mode("append").option("compression", compression).text(path)


def write_whole(texts: DataFrame, path: str) -> None:
    """One file per row of a one-column DataFrame, in a new folder; a null gives a file of one line break.

    In a plain file system tasks write the files themselves (`whole_texts` below). Elsewhere Spark's text writer does, and each task
    moves its own files into place (committer version 2): otherwise the driver would move them one after another at the end.
    Readers must wait for the write to return.
    """
    full = qualified(texts.sparkSession, path)
    if full.startswith("file:"):
        files, root = fs.FileSystem.from_uri(full)
        if files.get_file_info(root).type != fs.FileType.NotFound:
            raise FileExistsError(full)
        ship(__name__)
        ship(frames.__name__)
        texts.sparkSession.dataSource.register(WholeTexts)
        texts.toDF("value").write.format("whole_texts").option("path", full).mode("append").save()
        return
    moved_by_tasks = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    texts.toDF("value").write.options(**moved_by_tasks).option("maxRecordsPerFile", 1).text(path)


def write_vocab_json(vocab: DataFrame, path: str, per_file: int | None = None) -> None:
    """JSON objects of token -> id: a single one, or by choice one per `per_file` ids, each in its own file.

    The single object is what other tools read, and is made in one task: its size is the caller's to know.
    """
    entries = F.collect_list(F.struct("token", F.col("id").cast("bigint")))
    part = div("id", per_file) if per_file else F.lit(0).cast("bigint")
    objects = vocab.groupBy(part.alias("part")).agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    objects.write.partitionBy("part").text(path)


@dataclass
class _Part(WriterCommitMessage):
    file: str
    bytes: int
    lines: int


class WholeTexts(DataSource):
    """Each text a file of its own, closed by a line break. Spark's writer opens, checks, lists and moves every file by itself."""

    @classmethod
    def name(cls) -> str:
        return "whole_texts"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _WholeWriter(self.options["path"])


@dataclass
class _Attempt(WriterCommitMessage):
    name: str


class _WholeWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own names; the driver deletes those of attempts that do not count before the write returns."""

    def __init__(self, path: str):
        self.path, self.write_id = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        name, no = f"part-{TaskContext.get().partitionId():05d}-{self.write_id}-{uuid.uuid4().hex}", 0
        for batch in iterator:
            for text in batch.column(0).cast(pa.binary()):
                with files.open_output_stream(f"{root}/{name}-{no:09d}.txt", compression=None) as sink:
                    sink.write((text.as_py() or b"") + b"\n")
                no += 1
        return _Attempt(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete({m.name for m in messages if m})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete(set())

    def _delete(self, kept: set[str]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        for found in files.get_file_info(fs.FileSelector(root)):
            attempt = found.base_name.rpartition("-")[0]
            if self.write_id in attempt and attempt not in kept:
                files.delete_file(found.path)


class ZstdLines(DataSource):
    """Text lines in .zst files of many frames, readable by zstd itself and by Spark's own text source.

    A frame ends at a line's end, about every FRAME_BYTES of text. The file closes with a frame that zstd skips: where each
    frame starts, how long it is and how many lines it has. `readers.read_framed` deals frames out to tasks by it.
    """

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ZstdWriter(self.options["path"], int(self.options.get("level", ZSTD_LEVEL)), int(self.options.get("frame_bytes", FRAME_BYTES)))


class _ZstdWriter(DataSourceArrowWriter):
    """Each task attempt writes a file of its own name; the driver commits by writing one list of those that count.

    The list goes to `<path>.manifest` under a new name, in one step, so readers see all of a write or nothing. Files of
    attempts that were lost are in no list; of this write they are deleted too, for tools that read the folder itself.
    """

    def __init__(self, path: str, level: int, frame_bytes: int):
        self.path, self.level, self.frame_bytes = path.rstrip("/"), level, frame_bytes
        self.write_id = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import zstandard
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(self.path)
        name = f"part-{self.write_id}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.jsonl.zst"
        files.create_dir(root, recursive=True)
        tool = zstandard.ZstdCompressor(level=self.level)
        index, held, size, place = [], [], 0, 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as sink:
            for batch in iterator:
                for line in batch.column(0).cast(pa.binary()):
                    held.append((line.as_py() or b"") + b"\n")
                    size += len(held[-1])
                    if size >= self.frame_bytes:
                        frame = tool.compress(b"".join(held))
                        sink.write(frame)
                        index.append((place, len(frame), len(held)))
                        held, size, place = [], 0, place + len(frame)
            if held:
                frame = tool.compress(b"".join(held))
                sink.write(frame)
                index.append((place, len(frame), len(held)))
                place += len(frame)
            sink.write(frames.index_frame(index))
        return _Part(name, place, sum(n for _, _, n in index))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        parts = [part for part in messages if part]
        kept = {part.file for part in parts}
        files.create_dir(f"{root}.manifest", recursive=True)
        rows = "".join(json.dumps({"file": f"{self.path}/{p.file}", "bytes": p.bytes, "lines": p.lines}) + "\n" for p in parts)
        staged = f"{root}.manifest/_{self.write_id}"
        with files.open_output_stream(staged, compression=None) as sink:
            sink.write(rows.encode())
        files.move(staged, f"{root}.manifest/write-{self.write_id}.json")
        self._delete(files, root, kept)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete(*fs.FileSystem.from_uri(self.path), set())

    def _delete(self, files: fs.FileSystem, root: str, kept: set[str]) -> None:
        for found in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if found.base_name.startswith(f"part-{self.write_id}-") and found.base_name not in kept:
                files.delete_file(found.path)
