"""The Jaccard join on groups of near copies, and its hashes."""

import random

import numpy as np
from pyspark.sql import functions as F

from shardloom.llm import jaccard_join


def _shingles(text, width):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def _components(rows, width, percent):
    """The smallest linked doc_id of each document, by comparing all pairs."""
    sets, root = {i: _shingles(t, width) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {(i, len(sets[i]), find(i)) for i in sets}


def test_hot_family_against_all_pairs(spark):
    """One family whose members share from a third to nearly all of their shingles, many of them just above or below the border."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    parent = [rnd.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(parent)
        for _ in range(rnd.choice((0, 1, 2, 3, 4, 6, 10, 20))):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rnd.choice(vocabulary) for _ in range(120))) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width, percent in ((4, 85), (5, 80), (7, 60)):
        want = _components(rows, width, percent)
        assert len({c for _, _, c in want}) > 31
        assert {tuple(r) for r in jaccard_join.linked(table, width, percent).collect()} == want


def test_parities_never_exceed_the_difference():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        a = np.unique(rnd.integers(-(1 << 63), (1 << 63) - 1, n))
        b = np.unique(np.concatenate((a[: n // 2], rnd.integers(-(1 << 63), (1 << 63) - 1, n))))
        apart = np.unpackbits((jaccard_join.parities(a) ^ jaccard_join.parities(b)).view(np.uint8)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_order_counts_at_every_width_and_in_long_words():
    for width in (2, 5, 6, 7, 8, 9, 12):
        words = [f"w{i}" for i in range(width)]
        seen = set()
        for a in range(width):
            for b in range(a, width):
                swapped = list(words)
                swapped[a], swapped[b] = words[b], words[a]
                for wide in (width, width + 1):  # a whole shingle, and too few words for one
                    seen.add((wide, next(jaccard_join.shingle_sets([" ".join(swapped)], wide)).tobytes()))
        assert len(seen) == 2 * (1 + width * (width - 1) // 2)
    long = "a" + "x" * 69_998 + "b"
    one, two = jaccard_join.shingle_sets([long, "b" + long[1:65_536] + "a" + long[65_537:]], 4)
    three, four = jaccard_join.shingle_sets(["a" + "x" * 65_535 + "b", "b" + "x" * 65_535 + "a"], 4)
    assert one.tobytes() != two.tobytes() and three.tobytes() != four.tobytes()


def test_keep_first_leaves_one_of_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(30))
    other = " ".join(f"other{i}" for i in range(30))
    rows = [(1, text, "x")] * 3 + [(2, text, "y"), (3, other, "x"), (3, text, "x"), (None, other, "a"), (None, other, "b"), (None, None, "c")]
    rows += [(None, "", "d"), (None, None, "c"), (5, None, "e"), (5, None, "e"), (6, None, "e")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, _id string")
    kept = jaccard_join.keep_first(table)
    assert kept.columns == table.columns
    got = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted([(True, 1), (False, 0), (False, 0), (False, 0), (False, 0), (True, 5), (True, 6)])
    assert kept.filter(F.col("text") == other).count() == 1
