"""Every operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shardloom.llm import byte_bpe, chat, jaccard_join, licenses, line_dedup, mixing, quality, secrets, token_files, top_k

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, h1 string, node string"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(5)
    prose = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta iota".split()) for _ in range(60)) for _ in range(6)]
    near = prose[0].split()
    near[-1] = "other"
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [(10, prose[0]), (11, " ".join(near)), (12, None), (13, ""), (14, "two words"), (15, "two words"), (None, prose[1])]
    rows += [(16, "é ñ\n\nlong " * 3000), (17, "x" * 20000), (18, prose[2] + "\n" + prose[3]), (18, prose[2] + "\n" + prose[3])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", 0, "a", "b", "c") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.train(empty, labels) is None
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    for result in (
        quality.assess(empty, None),
        top_k.search(vectors, vectors),
        byte_bpe.round_trip(empty),
        jaccard_join.linked(empty),
        chat.chat_digest(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")),
        licenses.scan(empty),
        token_files.stored_digest(empty),
        secrets.scan(empty),
        mixing.mixed_sizes(empty),
        line_dedup.report(empty),
        mixing.mix(empty),
        line_dedup.dedup(empty),
        jaccard_join.keep_first(empty),
    ):
        assert result.collect() == []


def test_quality_counts_and_model(spark, docs):
    assert quality.counts("a b c\na b c\nx # <") == (9, 9, 2, 1, 6)
    assert quality.counts("a a a a") == (4, 4, 0, 0, 4)
    good = [(i, "the cat sat on a mat and the dog ran over hills " * 8 + str(i), 1) for i in range(60)]
    bad = [(100 + i, "zxq ### $$$ zzk qqx %%% wvw " * 10 + str(i), 0) for i in range(60)]
    rows = good + bad
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[::2]] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.train(table, labels)
    raws = [r[1].encode() for r in rows[1::2]]  # not trained on
    p = quality._logistic(model.slope * quality.scores(model, raws) + model.shift)
    assert ((p >= quality.THRESHOLD) == np.array([r[2] for r in rows[1::2]])).all()
    kept = quality.keep(docs, None)
    assert kept.columns == docs.columns
    assert kept.count() == quality.assess(docs, None).filter("kept").count()


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 40)
    rnd = np.random.default_rng(2)
    vectors = [(i, rnd.integers(-3, 4, 4).astype(float).tolist()) for i in range(150)]
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [1.0]), (None, [1.0] * 4), (250, [0.0] * 4)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in top_k.search(df, df.filter("vec_id % 50 = 0")).collect()}
    fine = [(i, np.floor(256 * np.array(v))) for i, v in vectors if i is not None and (i < 200 or i == 250)]
    want = set()
    for q, x in fine:
        if q % 50 == 0:
            order = sorted((-int(x @ y), i) for i, y in fine if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(order)}
    assert got == want


@pytest.mark.parametrize("times", [2, 20])
def test_top_k_repeated_rows(spark, times):
    rnd = np.random.default_rng(times)
    vectors = [(i, rnd.integers(-3, 4, 4).astype(float).tolist()) for i in range(200)]
    vectors += [(0, [9.0] * 4)] * times + [(50, [4.0, 4.0, 4.0, 4.0])] * times  # best for themselves; two queries each
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in top_k.search(df, df.filter("vec_id % 50 = 0")).collect())
    fine = [(i, np.floor(256 * np.array(v))) for i, v in vectors]
    want = []
    for q, x in {(q, tuple(x)) for q, x in fine if q % 50 == 0}:
        order = sorted((-int(np.array(x) @ y), i) for i, y in fine if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert got == sorted(want)


def test_top_k_touches_only_what_it_reads():
    """A search that may stop at once makes no copy of the lists, and gives what all scores give."""
    rnd = np.random.default_rng(4)
    rows = rnd.integers(-9, 10, (top_k.BLOCK_ROWS, 64))
    rows[:8] = rnd.integers(200, 210, (8, 64))
    lists, query = top_k.Lists(np.arange(len(rows)), rows), np.ones(64, np.int64)
    tracemalloc.start()
    found = lists.search(3, query, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(i, -s) for s, i in sorted((-int(x.sum()), i) for i, x in enumerate(rows) if i != 3)[:5]]
    assert peak < lists.order.nbytes / 4


def test_byte_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in texts():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in byte_bpe.round_trip(docs).collect())


def test_byte_bpe_edits():
    vocabulary = byte_bpe.Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))})
    rnd = random.Random(1)
    table = byte_bpe.PrefixTokens(vocabulary, b"start")
    for _ in range(60):
        a = rnd.randint(0, len(table.text))
        table.replace(a, min(len(table.text), a + rnd.randint(0, 4)), bytes(rnd.choice(b"abcde ") for _ in range(rnd.randint(0, 9))))
        table.append(b"ing")
        assert table.ids() == vocabulary.merged(table.text)


def test_jaccard(spark, docs):
    got = {tuple(r) for r in jaccard_join.linked(docs).collect()}
    sets = {}
    for i, t in texts():
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} - {()}
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                same = len(sets[a] & sets[b])
                if same and 100 * same >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {(i, len(sets[i]), root[i]) for i in ids} | {(None, len(sets[None]), None)}
    assert jaccard_join.keep_first(docs).columns == docs.columns


def test_chat(spark):
    odd = r"<s>[INST] a \ <\s> <sep></s>[/INST] [\INST] <</s>"
    turns = [(1, 0, "user", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (1, 3, "assistant", "b<"), (2, 0, None, ""), (None, 0, "[INST]", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_chats(df)
    read = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_chats(made).collect()}
    assert read[1] == [("user", odd), ("user", ""), ("assistant", odd), ("assistant", "b<")]
    assert read[2] == [("", "")] and read[None] == [("[INST]", "x")]
    row = next(r for r in chat.chat_digest(df).collect() if r.conv_id == 1)
    assert row.loss_sha256 == hashlib.sha256((odd + "b<").encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.n_blocks) == (4, len(odd) + 2, 2)


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")), (2, mit + " more"), (3, None), (4, "x\nReleased under the MIT licence!\ny")]
    got = {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ("MIT", 0, ""), 2: (None, 0, ""), 3: (None, 0, ""), 4: (None, 1, "MIT")}


def test_licenses_standard_files(spark):
    files = {p.name[:-4]: p.read_text() for p in licenses.Path(licenses.__file__).parent.joinpath("license_texts").glob("*.txt")}
    bsd = open("/usr/share/common-licenses/BSD").read() if licenses.Path("/usr/share/common-licenses/BSD").exists() else None
    rows = [(name, text) for name, text in files.items()]
    rows += [("MIT", f"{title}\n\nCopyright (c) 2021 A. Body\n\n{licenses.TEXTS['MIT']}\n") for title in ("MIT License", "The MIT License (MIT)")]
    rows += [("ISC", "ISC License\n\nCopyright 2004 B\n\n" + licenses.TEXTS["ISC"])]
    rows += [("Apache-2.0", files["Apache-2.0"].split("   APPENDIX")[0])]
    rows += [("GPL-3.0", files["GPL-3.0"].upper().replace("HTTPS", "HTTP"))]
    rows += [("BSD-3-Clause", bsd), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd)] if bsd else []
    table = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(table).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


def test_token_files(spark, docs):
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, token_files.END]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in token_files.stored_digest(docs).collect())


def test_secrets(spark):
    random_key = "Zx9Kq2Lw8Vb3Tn7Rm4Yc6Ph1"
    plain = "the international organization of an inner committee realizes the commission on the garden near a road " * 30
    rows = [(1, f"é Password = 'abcdef' {plain}"), (2, f"id {random_key} end {plain}"), (3, None), (4, f"AKIA{'A1' * 8} {'0a' * 12} token=abc")]
    rows += [(i, plain + "aninternationalizationcommittee ") for i in range(5, 9)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].spans == "assign:2:20"
    assert got[2].spans == f"random:3:{3 + len(random_key)}" and got[2].n_hex == 0
    assert got[3].spans == "" and got[4].spans == "access:0:20,hex:21:45" and got[5].spans == ""


def test_mixing(spark, docs):
    rows = mixing.mixed_sizes(docs).collect()
    assert len(rows) == len(texts())
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] += r.taken
    assert all(taken == int(target) for (_, target), taken in by.items())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in rows)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LISTED", 6)  # small groups already are segmented again
    rnd = random.Random(4)
    lines = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(8, 16))) for _ in range(6)]
    lines += [line[:k] + "é" + line[k + rnd.randint(0, 1) :] for line in lines for k in (1, 5, 7)]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(3))) for i in range(20)] + [(None, lines[0]), (30, None), (31, "")]
    got = {tuple(r) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string"), min_chars=5).collect()}
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            first.setdefault(line, (i is not None, i or 0, k))
    long = [x for x in first if len(x) >= 5]
    late = {max(a, b, key=first.get) for a in long for b in long if a != b and _distance(a, b) <= 1}
    want = set()
    for i, t in rows:
        parts = t.split("\n") if t is not None else []
        gone = [k for k, x in enumerate(parts) if len(x) >= 5 and (x in late or first[x] != (i is not None, i or 0, k))]
        want.add((i, len(parts), len(gone), ",".join(map(str, gone))))
    assert got == want


def test_line_dedup_keeps_columns(docs):
    kept = line_dedup.dedup(docs)
    assert kept.columns == docs.columns
    texts_by_id = {}
    for r in kept.collect():
        texts_by_id.setdefault(r.doc_id, r.text)
    assert texts_by_id[12] is None and texts_by_id[10] == ""  # 10 repeats 0
    assert texts_by_id[0] == texts()[0][1] and texts_by_id[14] == "two words"


def test_pipeline(spark):
    """Stages keep the columns; what comes out is what the plain libraries make of the last texts."""
    import corpus_pipeline

    sf_dir, seen = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(function(spark, docs, sf_dir), name)
        seen.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
    assert 0 < seen[-1] == before.count()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, library.encode_ordinary(r.text)) for r in before.select("doc_id", "text").collect())
    assert sorted((r.doc_id, list(r.ids)) for r in docs.collect()) == want


def test_line_dedup_edits_grow_with_length(spark, monkeypatch):
    rnd = random.Random(8)
    cases = [(chars, most) for first, most in line_dedup.BANDS for chars in (first, first + 3)] + [(600, 14)]
    rows, want, i = [], {}, 0
    for chars, most in cases:
        for edits in sorted({1, 2, most, most + 1, 2 * most + 2}):
            for kind in ("change", "insert", "delete"):
                line = "".join(rnd.choice("abcdefgh ijklmnop") for _ in range(chars))
                copy = list(line)
                for at in sorted(rnd.sample(range(chars), edits), reverse=True):
                    if kind == "delete":
                        del copy[at]
                    else:
                        copy[at : at + (kind == "change")] = [rnd.choice("QRSTUVWXYZ")]
                copy = "".join(copy)
                if len(copy) >= 20:
                    least = min(chars, len(copy))
                    near = _distance(line, copy) <= max(t for first, t in line_dedup.BANDS if first <= least)
                    rows += [(i, line), (i + 1, copy)]
                    want |= {i: 0, i + 1: int(near)}
                    i += 2
    assert any(want.values()) and sum(want.values()) < len(rows) / 2
    start, end = ("".join(rnd.choice("abc ") for _ in range(n)) for n in (150, 120))
    hot = [start + "".join(rnd.choice("abcdefgh") for _ in range(30)) + end for _ in range(10)]  # share all but 30 characters
    hot += [line[:40] + "é" + line[41:155] + "éé" + line[155:] for line in hot[:6]]
    rows += [(i + k, line) for k, line in enumerate(hot)]
    for k, line in enumerate(hot):
        want[i + k] = int(any(_distance(line, other) <= 14 for other in hot[:k]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(line_dedup, "LISTED", 6)
    assert {r.doc_id: r.n_removed for r in line_dedup.report(docs).collect()} == want


def test_line_dedup_short_repeats(spark):
    rows = [(1, "Share\n\nReply\n \t"), (2, "Share\n\nReplx\n \t\nShare"), (3, "Reply")]
    got = {r.doc_id: r.removed for r in line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "", 2: "0,4", 3: "0"}
