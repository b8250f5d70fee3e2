import datetime
import gzip
import io
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from shardloom.sources import frames, readers, writers

LINES = [
    {"text": "one", "meta": {"a": 1, "b": ["x"]}},
    {"text": ["p1", "p2"], "meta": {}},
    {"text": "no meta"},
    {"text": "line\nbreak é 漢"},
]


def put(path, objects, opener=open):
    with opener(path, "wb") as f:
        f.write("".join(json.dumps(o, ensure_ascii=False) + "\n" for o in objects).encode())
    return str(path)


def test_jsonl_texts_and_metadata(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", LINES)
    rows = readers.read_jsonl(spark, path, get_meta=True).orderBy("doc_no").collect()
    assert [r.text for r in rows] == ["one", "p1\n\np2", "no meta", "line\nbreak é 漢"]
    assert [json.loads(r.meta) for r in rows] == [{"a": 1, "b": ["x"]}, {}, {}, {}]
    assert [r.doc_no for r in rows] == [0, 1, 2, 3] and rows[0].shard.endswith("a.jsonl")


def test_jsonl_paragraphs_can_stay_a_list_or_join_otherwise(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", LINES[1:2])
    assert readers.read_jsonl(spark, path, para_joiner="|").first().text == "p1|p2"
    assert json.loads(readers.read_jsonl(spark, path, autojoin_paragraphs=False).first().text) == ["p1", "p2"]


def test_bare_strings_have_no_metadata(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", ["just text", {"text": "x"}])
    assert [r.text for r in readers.read_jsonl(spark, path).orderBy("doc_no").collect()] == ["just text", "x"]
    with pytest.raises(Exception, match="bare string"):
        readers.read_jsonl(spark, path, get_meta=True).collect()


@pytest.mark.parametrize("bad", [b"{broken\n", b'{"other": 1}\n', b"\n"])
def test_bad_lines_are_errors(spark, tmp_path, bad):
    (tmp_path / "a.jsonl").write_bytes(bad)
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()


def test_compressed_files(spark, tmp_path):
    plain = [{"text": f"t{i}"} for i in range(50)]
    gz = put(tmp_path / "a.jsonl.gz", plain, gzip.open)
    data = "".join(json.dumps(o) + "\n" for o in plain).encode()
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.ZstdCompressor(level=3).compress(data))
    for path in (gz, str(tmp_path / "b.jsonl.zst")):
        rows = readers.read_jsonl(spark, path).orderBy("doc_no").collect()
        assert [r.text for r in rows] == [o["text"] for o in plain]


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("x.txt", 9_000), ("y.txt", 100)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = readers.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        wrong = lines.filter(F.concat_ws(" ", F.element_at(F.split("shard", "/"), -1), "doc_no") != F.col("text"))
        assert lines.count() == 9_100 and wrong.isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_only_line_feeds_end_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\rb\nc\n")
    assert [r.text for r in readers.read_lines(spark, str(tmp_path)).orderBy("doc_no").collect()] == ["a\rb", "c"]


def test_field_and_whole_files(spark, tmp_path):
    path = put(tmp_path / "a.json", [{"content": "x", "id": 1}, {"content": "y\nz"}])
    assert [r.text for r in readers.read_field(spark, path).orderBy("doc_no").collect()] == ["x", "y\nz"]
    with pytest.raises(Exception, match="without content"):
        readers.read_field(spark, put(tmp_path / "b.json", [{"other": "x"}])).collect()
    (tmp_path / "w.txt").write_text("a\nb\n")
    assert readers.read_whole(spark, str(tmp_path / "w.txt")).first().text == "a\nb\n"


def test_vocabularies(spark, tmp_path):
    (tmp_path / "v.txt").write_text("the 10\n  of 3\nthe 2\n\tx\n")
    assert {r.token: r.id for r in readers.read_vocab_lines(spark, str(tmp_path / "v.txt")).collect()} == {"of": 1, "the": 2, "x": 3}
    (tmp_path / "bad.txt").write_text("a\n\nb\n")
    with pytest.raises(Exception, match="blank"):
        readers.read_vocab_lines(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "v.json").write_text(json.dumps({"a": 0, "é\"": 1}, indent=1))
    assert {r.token: r.id for r in readers.read_vocab_json(spark, str(tmp_path / "v.json")).collect()} == {"a": 0, "é\"": 1}


def test_vocabulary_files_hold_a_bounded_number_of_tokens(spark, tmp_path):
    vocab = spark.range(25).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"), "id")
    for per_file, files in ((10, 3), (100, 1)):
        path = tmp_path / f"v{per_file}"
        writers.write_vocab_json(vocab, str(path), per_file)
        assert len(list(path.glob("part=*/*.txt"))) == files
        assert {r.token: r.id for r in readers.read_vocab_json(spark, str(path)).collect()} == {f"t{i}": i for i in range(25)}


@pytest.mark.parametrize("codec", ["zstd", "gzip"])
def test_written_documents_come_back(spark, tmp_path, codec):
    docs = spark.createDataFrame([("a\n\"b\" é", '{"k": [1, "x"]}'), ("c", None)], "text string, meta string")
    path = str(tmp_path / "out")
    for _ in range(2):  # the sink appends
        writers.write_jsonl(docs.select(writers.json_line("text", F.col("meta"))), path, codec)
    back = readers.read_jsonl(spark, path, get_meta=True).collect()
    assert sorted((r.text, json.dumps(json.loads(r.meta))) for r in back) == sorted(2 * [("a\n\"b\" é", '{"k": [1, "x"]}'), ("c", "{}")])
    if codec == "zstd":
        files = list((tmp_path / "out").glob("part-*.jsonl.zst"))
        text = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_bytes())).read() for f in files)
        assert sorted(json.loads(line)["text"] for line in text.splitlines()) == sorted(2 * ["a\n\"b\" é", "c"])
        assert not list((tmp_path / "out").glob("_staged*"))


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = spark.range(0, 5_000, 1, 1).select(F.concat(F.lit("é "), F.col("id"), F.lit(" "), F.repeat(F.md5(F.col("id").cast("string")), 4)).alias("value"))
    writers.write_jsonl(lines, path, "zstd", frame_bytes=20_000)
    (file,) = (tmp_path / "out").glob("part-*.zst")
    with file.open("rb") as source:
        index = frames.read_index(source, file.stat().st_size)
    assert len(index) > 30 and sum(n for _, _, n in index) == 5_000
    back = readers.read_framed(spark, path, task_bytes=8_000)
    tasks = back.select("*", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in tasks}) > 3
    want = [r.value for r in lines.collect()]
    assert [(r.doc_no, r.text) for r in sorted(tasks, key=lambda r: r.doc_no)] == list(enumerate(want))
    plain = zstandard.ZstdDecompressor().stream_reader(file.open("rb"), read_across_frames=True).read()
    assert plain.decode().splitlines() == want
    by_spark = readers.read_lines(spark, path).collect()  # its own codec skips the index
    assert sorted((r.shard, r.doc_no, r.text) for r in by_spark) == sorted((r.shard, r.doc_no, r.text) for r in tasks)


def test_only_committed_files_are_read(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_jsonl(spark.createDataFrame([("a",), ("b",)], "value string"), path, "zstd")
    before = sorted((tmp_path / "out").glob("part-*"))
    stray = tmp_path / "out" / "part-other-00000-x.jsonl.zst"  # a lost attempt of a write that never ended
    stray.write_bytes(before[0].read_bytes())
    writer = writers._ZstdWriter(f"file://{path}", 3, 100)
    names = [f"part-{writer.write_id}-00000-{k}.jsonl.zst" for k in ("kept", "lost")]  # two attempts of one task
    for name in names:
        frame = zstandard.ZstdCompressor().compress(b"c\n")
        (tmp_path / "out" / name).write_bytes(frame + frames.index_frame([(0, len(frame), 1)]))
    assert sorted(r.text for r in readers.read_framed(spark, path).collect()) == ["a", "b"]  # not committed yet
    writer.commit([writers._Part(names[0], 11, 1), None])
    assert sorted(r.text for r in readers.read_framed(spark, path).collect()) == ["a", "b", "c"]
    assert not (tmp_path / "out" / names[1]).exists() and stray.exists()
    aborted = writers._ZstdWriter(f"file://{path}", 3, 100)
    (tmp_path / "out" / f"part-{aborted.write_id}-00000-x.jsonl.zst").write_bytes(b"")
    aborted.abort([None])
    assert not list((tmp_path / "out").glob(f"part-{aborted.write_id}-*"))


def test_empty_frames(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_jsonl(spark.createDataFrame([], "value string"), path, "zstd")
    assert readers.read_framed(spark, path).collect() == []
    assert frames.read_index(io.BytesIO(b"short"), 5) is None
    assert frames.read_index(io.BytesIO(b"x" * 100), 100) is None


def test_iso_times(spark):
    times = [datetime.datetime(2021, 4, 11, 1, 2, 3), datetime.datetime(2021, 4, 11, 1, 2, 3, 45)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert [r.s for r in df.select(writers.iso_timestamp("t").alias("s")).collect()] == [t.isoformat() for t in times]


def test_lines_survive_other_file_splits(spark, tmp_path):
    """Counts and lines come from one scan, so a cluster that grows in between changes nothing."""
    from shardloom.sources.readers import read_lines

    path = tmp_path / "many.txt"
    path.write_text("".join(f"line {i} {'x' * 40}\n" for i in range(120_000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        lines = read_lines(spark, str(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
        rows = lines.select("doc_no", "text").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_no for r in rows) == list(range(120_000))
    assert all(r.text.startswith(f"line {r.doc_no} ") for r in rows)


def test_one_file_per_document(spark, tmp_path):
    texts = [f"text {i}\n\nwith lines" for i in range(50)] + ["", "é"]
    writers.write_whole(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), str(tmp_path / "whole"))
    back = readers.read_whole(spark, str(tmp_path / "whole")).collect()
    assert len({r.shard for r in back}) == len(back) == 52
    assert sorted(r.text for r in back) == sorted(t + "\n" for t in texts)
    assert not (tmp_path / "whole" / "_temporary").exists()
