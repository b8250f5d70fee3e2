"""Files of one document each."""

import os

import pytest

from shardloom.sources import readers, writers


def test_tasks_write_whole_files_and_nothing_else(spark, tmp_path):
    """No check sum beside each file and no folder of moved ones: a write is one file per row."""
    path = str(tmp_path / "whole")
    texts = [f"text {i}\nsecond líne" for i in range(50)] + ["", None]
    writers.write_whole(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), path)
    assert len(os.listdir(path)) == len(texts)
    assert sorted(r.text for r in readers.read_whole(spark, path).collect()) == sorted(f"{t or ''}\n" for t in texts)
    with pytest.raises(FileExistsError):
        writers.write_whole(spark.range(1).selectExpr("'x' AS text"), path)


def test_files_of_lost_attempts_go(tmp_path):
    writer = writers._WholeWriter(f"file://{tmp_path}")
    for name in (f"part-00000-{writer.write_id}-kept", f"part-00000-{writer.write_id}-lost"):
        (tmp_path / f"{name}-000000000.txt").write_text("x\n")
    writer.commit([writers._Attempt(f"part-00000-{writer.write_id}-kept"), None])
    assert [f.name for f in tmp_path.iterdir()] == [f"part-00000-{writer.write_id}-kept-000000000.txt"]


def test_an_empty_table_writes_an_empty_folder(spark, tmp_path):
    writers.write_whole(spark.createDataFrame([], "text string"), str(tmp_path / "whole"))
    assert readers.read_whole(spark, str(tmp_path / "whole")).count() == 0


def test_many_small_files_are_few_tasks(spark, tmp_path):
    path, cores = str(tmp_path / "whole"), spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        writers.write_whole(spark.range(20 * cores).selectExpr("cast(id AS string)"), path)
        read = readers.read_whole(spark, path)
        assert read.rdd.getNumPartitions() <= readers.SHARES * cores
        assert sorted(int(r.text) for r in read.collect()) == list(range(20 * cores))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
