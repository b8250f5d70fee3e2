import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from tokenizers import Tokenizer, models, pre_tokenizers, trainers

from shardloom.functions.text import byte_level_words, bytes_to_text, words
from shardloom.operators import bpe, bpe_rounds, encode
from shardloom.operators import lookup as lookups
from shardloom.operators.lookup import lookup, map_items
from shardloom.session import stage
from shardloom.sources import readers


def plain_bpe(counts, vocab_size):
    """Sequential training, one merge at a time."""
    pieces = sorted({c for w in counts for c in w})
    ids = {p: i for i, p in enumerate(pieces)}
    split = {w: [ids[c] for c in w] for w in counts}
    merges = []
    while len(pieces) < vocab_size:
        pairs = Counter()
        for w, n in counts.items():
            for pair in zip(split[w], split[w][1:]):
                pairs[pair] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        spelling = pieces[best[0]] + pieces[best[1]]
        merges.append((pieces[best[0]], pieces[best[1]]))
        if spelling not in ids:
            ids[spelling] = len(pieces)
            pieces.append(spelling)
        for w, parts in split.items():
            joined, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == best:
                    joined.append(ids[spelling])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            split[w] = joined
    return pieces, merges, split


leads = bpe_rounds.leads


def random_words(seed, letters, n):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 6) for _ in range(n)}


@pytest.mark.parametrize("seed,letters,n", [(1, "ab", 30), (2, "abcde", 60), (3, "aé漢", 40)])
def test_training_equals_one_merge_at_a_time(spark, stager, seed, letters, n):
    counts = random_words(seed, letters, n)
    df = spark.createDataFrame(list(counts.items()), "token string, n bigint")
    size = len(set("".join(counts))) + 25
    pieces, merges, segmented = bpe.train(df, stager, vocab_size=size, stage_every=3)
    want_pieces, want_merges, want_split = plain_bpe(counts, size)
    assert (pieces, merges) == (want_pieces, want_merges)
    assert {r.token: r.ids for r in segmented.collect()} == want_split


def rounds_in_memory(counts, vocab_size, most):
    """The loop of train() over one batch of words, at most `most` merges a round."""
    letters = sorted({c for w in counts for c in w}, key=ord)
    wanted = max(vocab_size - len(letters), 0)
    symbols, row = bpe._spell(list(counts), np.array([ord(c) for c in letters], np.uint32))
    n = np.array(list(counts.values()), np.int64)
    found, order = bpe_rounds.Merges(len(letters)), []
    while wanted:
        turns = bpe_rounds.Turns(found, order)
        keys, count = bpe_rounds.pair_counts(symbols, row, n)
        left, right = keys >> 32, keys & 0xFFFFFFFF
        score = list(zip(-count, turns.of(left, right, count), turns.rank[left], turns.rank[right]))
        best = {}
        for k, s in enumerate(score):
            for symbol in ((right[k], "ends"), (left[k], "starts")):
                best[symbol] = min(best.get(symbol, s), s)
        leads = [k for k, s in enumerate(score) if s <= best.get((left[k], "ends"), s) and s <= best.get((right[k], "starts"), s)]
        leads = np.array(sorted(leads, key=lambda k: score[k])[:most], int)
        if len(order) >= wanted and len(leads):
            m = order[wanted - 1]
            leads = leads[bpe_rounds.before(turns, (left[leads], right[leads], count[leads]), (found.left[m], found.right[m], found.count[m]))]
        if not len(leads):
            break
        found.add(left[leads].tolist(), right[leads].tolist(), count[leads].tolist())
        order = found.sequence()
        symbols, row = bpe_rounds.merge(symbols, row, found.rounds[-1:])
    return found.spell(letters, order[:wanted])


@pytest.mark.parametrize("seed", range(300))
def test_rounds_equal_one_merge_at_a_time(seed):
    """Many ties, doubled letters, and merges found before their turn or in vain."""
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcd", "abcdefgh"])
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([4, 12])))): rng.choice([1, 1, 1, 2, 2, 3, 5]) for _ in range(rng.randint(1, 25))}
    size = rng.choice([8, 12, 20, 1000])
    want_pieces, want_merges, _ = plain_bpe(counts, size)
    assert rounds_in_memory(counts, size, rng.choice([1, 3, 1000])) == (want_pieces, want_merges)


@pytest.mark.parametrize("top,least", [(12, 1), (12, 6), (3, 1)])
def test_training_on_the_most_frequent_pairs_of_a_round(spark, stager, monkeypatch, top, least):
    """The driver sees a few pairs a round; with equal counts at the cut the executors decide. The merges stay the same."""
    monkeypatch.setattr(bpe, "TOP_PAIRS", top)
    monkeypatch.setattr(bpe, "LEAST_PAIRS", least)
    seen = []
    monkeypatch.setattr(bpe_rounds, "leads", lambda turns, left, *more: seen.append(len(left)) or leads(turns, left, *more))
    counts = random_words(11, "abcdefg", 150)
    df = spark.createDataFrame(list(counts.items()), "token string, n bigint")
    pieces, merges, segmented = bpe.train(df, stager, vocab_size=25)
    want_pieces, want_merges, want_split = plain_bpe(counts, 25)
    assert (pieces, merges) == (want_pieces, want_merges) and max(seen) <= top
    assert {r.token: r.ids for r in segmented.collect()} == want_split


def test_training_equals_the_tokenizers_library(spark, stager):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 40")
    pieces, merges, _ = bpe.train(encode.word_counts(docs), stager, vocab_size=150)
    tokenizer = Tokenizer(models.BPE())
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.train_from_iterator([r.text for r in docs.collect()], trainers.BpeTrainer(vocab_size=150, show_progress=False))
    vocab = tokenizer.get_vocab()
    assert pieces == sorted(vocab, key=vocab.get)
    encoded = bpe.segment(encode.word_counts(docs), merges, {p: i for i, p in enumerate(pieces)}).collect()
    assert all(r.ids == tokenizer.encode(r.token).ids for r in encoded)


@pytest.mark.parametrize("limit", [0, 1000])
def test_map_items_both_ways(spark, limit):
    items = [(1, ["a", "b", "z"]), (2, []), (3, ["b"] * 5), (4, ["a"]), (4, ["b"]), (5, ["n", "z"]), (6, None)]
    rows = spark.createDataFrame(items, "k int, items array<string>")
    table = spark.createDataFrame([("a", 10, True), ("b", 20, False), ("n", None, False)], "item string, value bigint, hot boolean")
    got = map_items(rows, ["k"], "items", table, -1, "ids", map_side_rows=limit).collect()
    want = [(1, [10, 20, -1]), (2, []), (3, [20] * 5), (4, [10]), (4, [20]), (5, [None, -1]), (6, [])]
    assert sorted(((r.k, r.ids) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("limit", [0, 1000])
def test_map_items_hands_back_some_items_at_a_time(spark, monkeypatch, limit):
    """What an array becomes is made in the task, for some arrays at a time, with nulls, empty arrays and long ones among them."""
    monkeypatch.setattr(lookups, "AT_ONCE", 4)
    rng = random.Random(8)
    names = [f"w{i}" for i in range(12)]
    arrays = [None if i % 9 == 4 else [rng.choice([*names, "unknown", None]) for _ in range(rng.choice((0, 1, 2, 7)))] for i in range(60)]
    lists = pa.array(arrays, pa.list_(pa.string()))
    ranges = list(lookups._some(lists))
    assert [i for r in ranges for i in range(len(lists))[r]] == list(range(len(lists)))
    assert all(len(range(len(lists))[r]) == 1 or len(lists[r].flatten()) <= 4 for r in ranges) and len(ranges) > 20
    rows = spark.createDataFrame(list(enumerate(arrays)), "k int, items array<string>").coalesce(1)
    for value, kind, default, made, put in (
        (lambda i: [i] * (i % 3), "array<bigint>", [], lookups.flattened(ArrayType(LongType())), lambda vs: [x for v in vs for x in v]),
        (lambda i: "x" * (i % 3), "string", "", lookups.joined("-"), lambda vs: "-".join(v for v in vs if v)),
    ):
        values = {w: value(i) for i, w in enumerate(names)}
        table = spark.createDataFrame([(w, v, i < 5) for i, (w, v) in enumerate(values.items())], f"item string, value {kind}, hot boolean")
        got = map_items(rows, ["k"], "items", table, default, "out", map_side_rows=limit, made=made).collect()
        assert {r.k: r.out for r in got} == {k: put([values.get(w, default) for w in a or []]) for k, a in enumerate(arrays)}


def test_map_items_moves_rare_items_only(spark, monkeypatch):
    """Frequent items are replaced where the arrays are; an array joins what it misses once an item, in any place and type."""
    stored = []
    monkeypatch.setattr(lookups, "stage", lambda df, label: stored.append(stage(df, label)) or stored[-1])
    rng = random.Random(5)
    names = [f"w{i}" for i in range(40)]
    arrays = [[rng.choice([*names, "unknown", None]) for _ in range(rng.randint(0, 30))] for _ in range(200)] + [["w0", "w1", "w0"]]
    rows = spark.createDataFrame(list(enumerate(arrays)), "k int, items array<string>")
    values = {w: [i] * (i % 3) for i, w in enumerate(names)}
    table = spark.createDataFrame([(w, v, i < 10) for i, (w, v) in enumerate(values.items())], "item string, value array<bigint>, hot boolean")
    got = map_items(rows, ["k"], "items", table, [], "out", map_side_rows=0).collect()
    assert {r.k: r.out for r in got} == {k: [values.get(w, []) for w in a] for k, a in enumerate(arrays)}
    head = set(names[:10])
    assert {r.k: sorted(r.missed) for r in stored[0].collect()} == {k: sorted({w for w in a if w and w not in head}) for k, a in enumerate(arrays)}


def test_lookup_evaluates_its_rows_once(spark):
    """Nested lookups into large tables: the plan grows by a join each, and copies only rows that are hot."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(100).select("id", (F.col("id") % 7).alias("k")).mapInPandas(count, "id bigint, k bigint")
    table = spark.range(7).select(F.col("id").alias("k"), (F.col("id") < 1).alias("hot"))
    for name in ("a", "b", "c"):
        rows = lookup(rows, ["k"], table.withColumn(name, F.col("k") + 1), F.col("id"), head_rows=1)
    got = rows.collect()
    assert sorted(r.id for r in got) == list(range(100)) and all(r.a == r.b == r.c == r.k + 1 for r in got)
    assert read.value == 100


def test_broadcasts_are_bounded_by_bytes(spark):
    few_but_wide = spark.range(40).select("id", F.lit("x").alias("text")).withColumn("text", F.repeat("text", F.lit(1 << 20)))
    assert not lookups._fits(few_but_wide, 100) and lookups._fits(few_but_wide.limit(3), 100)


def test_lookup_with_head_and_tail(spark):
    rows = spark.range(1_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), (F.col("id") < 5).alias("hot"))
    for head in (5, 100):
        got = lookup(rows, ["k"], table, F.col("id"), head_rows=head).collect()
        assert len(got) == 1_000
        assert all(r.v == (r.k * 2 if r.k < 40 else None) for r in got)


def test_encode_decode(spark, stager):
    docs = spark.createDataFrame([(1, "the cat the dog"), (2, "the bird"), (3, "")], "doc int, text string")
    vocab = encode.rank_vocab(encode.word_counts(docs.filter("doc = 1")), stager)
    assert {r.token: r.id for r in vocab.collect()} == {"the": 0, "cat": 1, "dog": 2, "<unk>": 3, "<bos>": 4, "<eos>": 5}
    ids = encode.encode(docs.withColumn("tokens", words("text")), ["doc"], vocab)
    assert {r.doc: r.ids for r in ids.collect()} == {1: [0, 1, 0, 2], 2: [0, 3], 3: []}
    assert {r.doc: r.text for r in encode.decode(ids, ["doc"], vocab, ids="ids").collect()} == {1: "the cat the dog", 2: "the", 3: ""}


def test_bpe_round_trip(spark, stager):
    docs = spark.createDataFrame([(1, "low lower lowest"), (2, "newer wider low low")], "doc int, text string")
    pieces, merges, segmented = bpe.train(encode.word_counts(docs), stager, vocab_size=20)
    ids = bpe.encode_pieces(docs.withColumn("tokens", words("text")), ["doc"], segmented)
    text = bpe.decode_pieces(ids, ["doc"], bpe.piece_table(spark, pieces))
    assert {r.doc: r.text for r in text.collect()} == {1: "lowlowerlowest", 2: "newerwiderlowlow"}
    library = Tokenizer(models.BPE({p: i for i, p in enumerate(pieces)}, merges))
    spaced = bpe.decode_pieces(ids, ["doc"], bpe.piece_table(spark, pieces), joiner=" ")
    assert {r.doc: r.text for r in spaced.collect()} == {r.doc: library.decode(r.ids) for r in ids.collect()}
    again = bpe.segment(segmented, merges, {p: i for i, p in enumerate(pieces)})
    assert {r.token: r.ids for r in again.collect()} == {r.token: r.ids for r in segmented.collect()}


def test_a_stored_tokenizer_is_used_again(spark, stager, tmp_path):
    counts = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6)], "token string, n bigint")
    path = str(tmp_path / "tokenizer.json")
    first = bpe.load_or_train(counts, path, stager, vocab_size=14)
    other = spark.createDataFrame([("zzz", 1)], "token string, n bigint")
    assert bpe.load_or_train(other, path, stager, vocab_size=14) == first
    vocab = bpe.tokenizer_vocab(first[0])
    assert [vocab[t] for t in ("<bos>", "<eos>", "<unk>")] == [14, 15, 16]


def test_byte_level_encoding_equals_the_tokenizers_library(spark, tmp_path):
    """Any vocabulary and merges files work; here small ones trained by the library."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 30").select("doc_id", "text")
    rows = docs.collect()
    tokenizer = Tokenizer(models.BPE())
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    alphabet = pre_tokenizers.ByteLevel.alphabet()
    tokenizer.train_from_iterator(
        [r.text for r in rows], trainers.BpeTrainer(vocab_size=500, show_progress=False, initial_alphabet=alphabet)
    )
    tokenizer.model.save(str(tmp_path))
    vocab = {r.token: r.id for r in readers.read_vocab_json(spark, str(tmp_path / "vocab.json")).collect()}
    merges = readers.read_merges(spark, str(tmp_path / "merges.txt")).orderBy("merge_no").collect()
    tokens = docs.select("doc_id", byte_level_words("text").alias("tokens"))
    counts = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    segmented = bpe.segment(counts, [(m.left, m.right) for m in merges], vocab).join(counts, "token")
    ids = bpe.encode_pieces(tokens, ["doc_id"], segmented)
    want = {r.doc_id: tokenizer.encode(r.text).ids for r in rows}
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    pieces = spark.createDataFrame([(i, p) for p, i in vocab.items()], "id bigint, piece string")
    back = bpe.decode_pieces(ids, ["doc_id"], pieces).select("doc_id", bytes_to_text("text").alias("text"))
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in rows}


def test_full_training_equals_the_tokenizers_library(spark, stager):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 40")
    pieces, merges, _ = bpe.train(encode.word_counts(docs), stager, vocab_size=30_000)
    tokenizer = Tokenizer(models.BPE())
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.train_from_iterator([r.text for r in docs.collect()], trainers.BpeTrainer(vocab_size=30_000, show_progress=False))
    vocab = tokenizer.get_vocab()
    assert len(pieces) > 1_000 and pieces == sorted(vocab, key=vocab.get)


def test_routed_words_equal_the_tokenizers_library(spark, stager):
    """Each row by its own tokenizer; characters without a piece leave a word before it is merged; repeated rows stay."""
    docs = {"en": "low lower lowest newer wider low new", "de": "über übel hübsch über übrig hübscher"}
    counted = [(lang, w, n) for lang, text in docs.items() for w, n in Counter(text.split()).items()]
    counts = stager(spark.createDataFrame(counted, "lang string, token string, n bigint"))
    trained = bpe.train_each(counts, "lang", ["de", "en"], stager, vocab_size=30)
    assert trained["en"] == bpe.train(counts.filter("lang = 'en'"), stager, vocab_size=30)[:2]
    words_ = ["lower", "übrig", "lüower", "new-new", "漢", "hübschest", ""]
    rows = [(route, w) for route in ("en", "de") for w in words_] + [("xx", "low")]
    got = {(r.route, r.token): (r.ids, r.n_unknown) for r in bpe.segment_routed(spark.createDataFrame(rows, "route string, token string"), trained).collect()}
    for name, (pieces, merges) in trained.items():
        library = Tokenizer(models.BPE(vocab={p: i for i, p in enumerate(pieces)}, merges=merges))
        for w in words_:
            assert got[name, w] == (library.encode(w).ids, sum(c not in pieces for c in w)), (name, w)
    assert got["xx", "low"] == ([], 3)

    segmented = stager(spark.createDataFrame([(r, t, 1, i) for (r, t), (i, _) in got.items()], "route string, token string, n bigint, ids array<bigint>"))
    texts = [(1, "en", ["lower", "new-new"]), (1, "en", ["lower", "new-new"]), (2, "de", ["lower", "übrig"]), (3, "de", []), (4, None, ["lower"])]
    df = spark.createDataFrame(texts, "doc bigint, route string, tokens array<string>")
    want = sorted((d, sum((got[r, t][0] for t in ts), []) if r else []) for d, r, ts in texts)
    assert sorted((r.doc, r.ids) for r in bpe.encode_routed(df, ["doc"], segmented).collect()) == want
