"""The filter audit, the packing and the hash tree against plain versions, on rows with nulls, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shardloom.llm import best_fit, filter_audit, merkle, queries, token_files

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mask int, name string, at bigint, part string, level int"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6)))
    made = []
    for i in range(700):
        text = " ".join(word() for _ in range(rnd.choice([3, 150, 250, 400])))
        text = text.upper() if i % 11 == 0 else text
        made.append((i, text + (" #" if i % 7 == 0 else ""), "en", "hot" if i % 3 else f"s{i % 40}", i))
    made += [(1000 + i, made[i % 5][1], None, ["hot", "", None][i % 3], None) for i in range(60)]  # copies, null and empty sources
    made += [(None, made[0][1], "fr", "hot", 3), (None, None, None, None, None), (2000, "", "", "", 0), (2001, None, "en", "a", 1)]
    made += [(3000, "one two", "en", "single", 7)] + [(3001, "Twice Said", "en", "twice", 7)] * 2 + [(3002, "x" * 300_000, "en", "hot", 1)]
    made += [(3003, "İstanbul’s <|endoftext|> \x85 it's 12" * 50, "de", "ü", 5)]
    return [r + (1, "n", 2, "p", 3) for r in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark):
    made = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 700, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1), (3001, 1, None), (9999, 1, 1)]
    return spark.createDataFrame(made, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def con(docs, labels):
    con = duckdb.connect()
    documents, marked = docs.toArrow(), labels.toArrow()
    con.register("documents", documents)
    con.register("labels", marked)
    return con


def plain_masks():
    first = {}
    for i, text, *_ in rows():
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, _, source, *_ in rows():
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * capitals > 2 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text) + "E" * (i is not None and i > first[text])
        yield i, source or "", fails


def test_filter_audit(docs, labels, con):
    marks = {}
    for i, quality, toxic in labels.collect():
        if i is not None:
            old = marks.get(i, (False, False))
            marks[i] = (old[0] or quality == 1, old[1] or toxic == 1)
    want = {}
    masks = list(plain_masks())
    removed_over_orders = {}
    for order in map("".join, permutations("ABCDE")):
        for i, part, fails in masks:
            gone = False
            for step, f in enumerate(order, 1):
                row = want.setdefault((part, order, step), [0] * 6)
                hit = f in fails
                row[0] += not hit and not gone
                row[1] += hit and not gone
                row[2] += hit and gone
                row[3] += fails == f
                row[4] += hit and not gone and marks.get(i, (0, 0))[0]
                row[5] += hit and not gone and marks.get(i, (0, 0))[1]
                removed_over_orders[part, f] = removed_over_orders.get((part, f), 0) + (hit and not gone)
                gone |= hit
    want = {(p, o, s, *row, removed_over_orders[p, o[s - 1]]) for (p, o, s), row in want.items()}
    result = filter_audit.audit(filter_audit.failures(docs, labels))
    got = [tuple(r) for r in result.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert set(con.execute(queries._AUDIT).fetchall()) == want


def test_audit_other_letters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 2, 0), ("p", 1, 3, 1, 1), ("p", 3, 1, 0, 1), ("p", 3, 1, 1, 0)], "part string, mask bigint, docs bigint, good bigint, toxic bigint")
    got = {tuple(r) for r in filter_audit.audit(cells, "XY").collect()}
    assert got == {
        ("p", "XY", 1, 5, 5, 0, 3, 2, 2, 8),
        ("p", "XY", 2, 5, 0, 2, 0, 0, 0, 2),
        ("p", "YX", 1, 8, 2, 0, 0, 1, 1, 2),
        ("p", "YX", 2, 5, 3, 2, 3, 1, 1, 8),
    }


@pytest.mark.parametrize("length, window, most_open", [(64, 16, 8), (2048, 2048, 2048)])
def test_best_fit(spark, docs, length, window, most_open):
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, text, *_ in rows():
        # Runs of anything but white space, as the library handles special tokens' strings one by one.
        ids = library.encode(text or "", add_special_tokens=False).ids + [best_fit.END]
        for k, low in enumerate(range(0, len(ids), length)):
            part = ids[low : low + length]
            want.append((str(i), k, low, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    placed = best_fit.pieces(docs, length).cache()
    got = [tuple(r) for r in best_fit.pack(placed, length, most_open, window, task_tokens=50_000).collect()]
    assert sorted((str(g[0]), *g[1:5]) for g in got) == sorted(want)
    sequences = {}
    for g in got:
        sequences.setdefault(g[5], []).append((g[6], g[3]))
    for parts in sequences.values():
        assert [offset for offset, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
        assert sum(n for _, n in parts) <= length
    total = sum(w[3] for w in want)
    assert len(sequences) <= 1.08 * -(-total // length) + 2


def test_bins():
    bins = best_fit.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 10, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    assert (bins.open, bins.bits) == (0, 0)
    assert [bins.place(n) for n in (5, 7, 8, 5)] == [(3, 0), (4, 0), (5, 0), (3, 5)]  # bin 4, the fullest of two, closes for 5


def test_encoder_matches_library():
    library, tool = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    texts = ["it's THE'LL x'd 'tis ''s don't ...!?", "a<|startoftext|>b <|endoftext|>", "Œuvre café́ naïve ÀÉ ß µ ª²³ ½x", "\x85a\xa0b c　d", "\xa0 ", "\n", ""]
    texts += ["x" * 5000 + "!" * 3000, "1234 5a6b", "日本語 テスト’s", "\x00a\x1fb\x7f \xad", "AİB İ", " both  ends\t"]
    for some in (texts, texts[:1], texts[-1:], []):
        want = [np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for t in some]
        assert tool.encode(some) == want


def plain_manifest():
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: h(part(i), part(source), part(lang), part(n), part(text))
    by_source = {}
    for i, text, lang, source, n, *_ in rows():
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        changed = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        own = leaf(i, text, lang, source, n)
        by_source.setdefault(source, []).append((i is not None, i or 0, own, leaf(i, low, lang, source, n) if changed else own, i))

    def tree(nodes):
        sides, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(where):
                run, place = nodes[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                sides[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
            nodes = [h(*nodes[j : j + 16]) for j in range(0, len(nodes), 16)]
            where = [at // 16 for at in where]
        return nodes[0], sides

    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, _, leaf, _, _ in sorted(by_source[s])]) for s in order}
    root, outer = tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, outer):
        subroot, sides = trees[s]
        for (_, _, own, now, i), near in zip(sorted(by_source[s]), sides):
            node = now
            for left, right in near + above:
                node = h(left, node, right)
            out.append((i, own, subroot, root, h(*(a + b for a, b in near + above)), node, node == root))
    return out


def test_merkle(docs, con):
    want = sorted(plain_manifest(), key=str)
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)
    assert got == want
    assert {w[-1] for w in want} == {True, False}
    assert sorted(con.execute(queries._MERKLE).fetchall(), key=str) == want


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_merkle_sizes(spark, n):
    """One source alone: the heights at which levels begin, each leaf proven."""
    made = [(i, f"Text {i}", "en", "s", i) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()
    assert len(got) == n and len({r.root for r in got}) == 1 and got[0].root == got[0].subroot
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0) for r in got)
    assert n > 1 or got[0].root == got[0].leaf


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(docs, labels)).collect() == []
    assert best_fit.best_fit(docs).collect() == []
    assert merkle.manifest(docs).collect() == []
