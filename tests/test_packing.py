import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.operators import packing
from shardloom.operators.batching import batch_blocks, collate
from shardloom.operators.ordering import add_streams, interleave, shard_order, shuffle_docs, stream_offsets
from shardloom.operators.packing import count_blocks, limit_tokens, pack, triggers
from shardloom.plans import corpus
from shardloom.session import new_path
from shardloom.streaming.packing import pack_stream, read_packed


def walk(docs, length):
    """Blocks and the number of the document that emitted each, token by token."""
    block, out = [], []
    for number, tokens in docs:
        for token in tokens:
            if len(block) == length:
                out.append((block, number))
                block = []
            block.append(token)
    return out


def frame(spark, shards, chunk_docs=3):
    rows = [
        (shard, i // chunk_docs, i, tokens, len(tokens)) for shard, docs in shards.items() for i, tokens in enumerate(docs)
    ]
    return spark.createDataFrame(rows, "shard string, chunk bigint, doc_no bigint, tokens array<bigint>, n bigint")


def random_shards(seed, longest=40):
    rng = random.Random(seed)
    counter = iter(range(10**6))
    return {
        f"s{i}": [[next(counter) for _ in range(rng.choice([0, 2, rng.randint(1, longest)]))] for _ in range(n)]
        for i, n in enumerate([1, 4, 12, 60])
    }


def packed(blocks):
    return {(r.shard, r.block_no): (r.tokens, r.trigger) for r in blocks.collect()}


def expected(shards, length):
    return {
        (shard, b): (tokens, number)
        for shard, docs in shards.items()
        for b, (tokens, number) in enumerate(walk(enumerate(docs), length))
    }


@pytest.mark.parametrize("seed,length", [(1, 8), (2, 5), (3, 64), (4, 1)])
def test_pack_equals_a_token_walk(spark, seed, length):
    shards = random_shards(seed)
    docs = frame(spark, shards)
    want = expected(shards, length)
    assert packed(pack(docs, ["shard"], ["doc_no"], length, provenance=F.col("doc_no"))) == want
    fired = triggers(docs, ["shard"], ["doc_no"], length, F.col("doc_no")).collect()
    assert {(r.shard, r.block_no): r.trigger for r in fired} == {k: v[1] for k, v in want.items()}
    for r in count_blocks(docs, ["shard"], length).collect():
        assert r.n_blocks == sum(shard == r.shard for shard, _ in want)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(lengths=st.lists(st.integers(0, 30), min_size=1, max_size=12), length=st.integers(1, 10))
def test_pack_any_lengths(spark, lengths, length):
    shards = {"s": [[100 * i + j for j in range(n)] for i, n in enumerate(lengths)]}
    assert packed(pack(frame(spark, shards), ["shard"], ["doc_no"], length, provenance=F.col("doc_no"))) == expected(shards, length)


def test_a_full_tail_is_dropped_unless_kept(spark):
    docs = frame(spark, {"s": [list(range(8))]})
    assert pack(docs, ["shard"], ["doc_no"], 4).count() == 1
    assert pack(docs, ["shard"], ["doc_no"], 4, keep_full_tail=True).count() == 2
    assert pack(frame(spark, {"s": [list(range(7))]}), ["shard"], ["doc_no"], 4, keep_full_tail=True).count() == 1


def test_token_limit(spark):
    blocks = pack(frame(spark, {"s": [list(range(100))]}), ["shard"], ["doc_no"], 10)
    assert sorted(r.tokens_seen for r in limit_tokens(blocks, 10, 35).collect()) == [10, 20, 30]
    assert limit_tokens(blocks, 10).count() == 9


def test_shuffle_keeps_chunks_and_interleave_numbers_all_blocks(spark):
    shards = random_shards(7)
    docs = frame(spark, shards).drop("chunk")
    streams = 3
    copies = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("stream"))
    shuffled = shuffle_docs(copies, F.col("stream"), 4, ("stream", "shard"))
    assert shuffled.filter("chunk <> doc_no div 4").isEmpty()
    places = shuffled.groupBy("stream", "shard", "chunk").agg(F.array_sort(F.collect_list("doc_i")).alias("p")).collect()
    assert all(list(r.p) == list(range(len(r.p))) for r in places)
    orders = {tuple(r.doc_no for r in shuffled.filter(f"stream = {s} and shard = 's3'").orderBy("chunk", "doc_i").collect()) for s in range(streams)}
    assert len(orders) == streams

    blocks = pack(shuffled, ["stream", "shard"], ["shuffle_key"], 6)
    offsets = stream_offsets(count_blocks(copies, ["stream", "shard"], 6), shard_order(docs.select("shard").distinct(), streams))
    mixed = interleave(blocks, offsets, streams, n_epochs=2)
    seqs = sorted(r.mix_seq for r in mixed.select("mix_seq").collect())
    assert seqs == list(range(len(seqs))) and len(seqs) == 2 * blocks.count()

    sized = mixed.withColumn("total", F.lit(len(seqs)))
    batches = collate(batch_blocks(sized, "mix_seq", "total", 7), []).collect()
    assert len(batches) == len(seqs) // 7
    by_seq = {r.mix_seq: r.tokens for r in mixed.collect()}
    for r in batches:
        assert r.matrix == [by_seq[r.batch_id * 7 + i] for i in range(7)]


@pytest.mark.parametrize("hot_share", [0.4])
def test_a_hot_shard_is_packed_right(spark, hot_share):
    rng = random.Random(3)
    shards = {"hot": [[i * 100 + j for j in range(rng.randint(1, 50))] for i in range(400)]}
    shards |= {f"s{k}": [[j for j in range(rng.randint(1, 50))] for _ in range(20)] for k in range(20)}
    assert packed(pack(frame(spark, shards, 16), ["shard"], ["doc_no"], 16, provenance=F.col("doc_no"))) == expected(shards, 16)


def test_stream_equals_batch(spark):
    shards = random_shards(11)
    docs = frame(spark, shards).drop("chunk")
    arrivals, out, progress = (new_path(spark, x) for x in ("arrivals", "out", "progress"))
    for low, high in ((0, 2), (2, 3), (3, 20), (20, 100)):
        docs.filter(f"doc_no >= {low} and doc_no < {high}").write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(docs.schema).parquet(arrivals)
        pack_stream(stream, out, progress, 7, ["shard"], 3).awaitTermination()
    assert packed(read_packed(spark, out)) == expected(shards, 7)


def test_copies_of_streams_are_placed_without_their_tokens(spark, monkeypatch):
    """Every stream packs its own order; what is copied and sorted once a stream has lengths only, and the blocks are those of pack."""
    shards = random_shards(13)
    docs = frame(spark, shards).drop("chunk").filter("n > 0")
    shuffled = shuffle_docs(add_streams(docs, 3), F.col("stream"), 4, ("stream", "shard"))
    scope, source = ["stream", "shard"], F.col("doc_no")
    want = pack(shuffled, scope, ["shuffle_key"], 6, provenance=source).collect()
    starts = packing.offsets(shuffled.drop("tokens"), scope, ["shuffle_key"]).select("shard", "doc_no", "stream", "n", "start")
    placed = packing.place_copies(docs, starts, ["shard", "doc_no"])
    assert sorted(map(str, packing.pack_placed(placed, scope, 6, provenance=source).collect())) == sorted(map(str, want))

    seen, plain = [], packing.offsets
    monkeypatch.setattr(packing, "offsets", lambda docs, *rest: seen.append(docs.columns) or plain(docs, *rest))
    corpus.mixed_blocks(spark, "/root/testdata/sf0.001", "train", 3, 2)
    assert len(seen) == 1 and "tokens" not in seen[0]


def test_words_move_as_texts(spark, monkeypatch):
    """Slices of words travel as one text each; nulls, empty words and words with the separator come back as they were."""
    rng = random.Random(17)
    odd = ["", "a", "é", "b c", None, packing.SEPARATOR, f"x{packing.SEPARATOR}y", "|", "\\"]
    docs = [[rng.choice(odd if i % 2 else ["", "a", "word"]) for _ in range(rng.randint(1, 12))] for i in range(60)]
    rows = spark.createDataFrame([("s", i, i // 5, d, len(d)) for i, d in enumerate(docs)], "shard string, doc_no bigint, chunk bigint, tokens array<string>, n bigint")
    moved, plain = [], packing._narrow
    monkeypatch.setattr(packing, "_narrow", lambda kind: moved.append(kind) or plain(kind))
    blocks = pack(rows, ["shard"], ["doc_no"], 4).orderBy("block_no").collect()
    whole = [t for d in docs for t in d]
    assert [b.tokens for b in blocks] == [whole[i * 4 : i * 4 + 4] for i in range((len(whole) - 1) // 4)]
    assert moved
