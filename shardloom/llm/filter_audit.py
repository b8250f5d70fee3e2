"""What each filter removes under every order of the filters, alone and together with the others.

Every document gets a mask with one bit per filter that it fails. A part has at most 2 ** n masks, so it shrinks to that many
cells of counts before anything depends on an order. Each cell is then folded across the array of all orders with higher-order
functions, giving one struct of counts per (order, step), and the cells of a part are merged by elementwise sums.

The five filters of `failures` are fixed: A under 200 words, B fewer than half of the words distinct, C more than 2 per cent of
the code points A-Z, D any of #$%&*|, E a text that a smaller doc_id of the table has.

Nulls: a null text is empty, a null source is the part of the empty one. A null doc_id is neither smaller nor larger than
another: such a row never fails E and makes no other fail it. Rows with one doc_id and one text do not repeat each other. Labels
belong to all rows with their doc_id; of several labels of one doc_id any 1 counts, nulls and rows without a doc_id count
nothing. Columns other than doc_id, source and text are ignored. Texts of any length are read whole, one at a time. An empty
table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shardloom.llm.common import send
from shardloom.session import stage

LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_CAPITALS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def text_mask(raw: bytes) -> int:
    """Bits 1, 2, 4 and 8 for the filters that look at one text only."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    fails = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * capitals > 2 * len(raw.translate(None, _FOLLOWING)),
        len(raw.translate(None, _MARKS)) < len(raw),
    )
    return sum(fail << i for i, fail in enumerate(fails))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)]
        digests = pa.array([hashlib.sha256(raw).digest() for raw in raws], pa.binary())
        masks = pa.array([text_mask(raw) for raw in raws], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, masks], ["part", "id", "digest", "mask"])


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) and labels(doc_id, quality, toxic) to cells: part, mask, docs, good, toxic (counts).

    Texts are read once; a digest stands for each from there on, in a written table that is read several times. Rows with the smallest doc_id of their digest are found by a
    join on both, so that thousands of copies of a text are spread by their doc_ids, and equal rows are one row with a count.
    """
    send(__name__)
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("bigint").alias("id"), "text")
    rows = rows.mapInArrow(_read, "part string, id bigint, digest binary, mask int")
    rows = stage(rows.groupBy("part", "id", "digest", "mask").agg(F.count("*").alias("docs")), "audit-rows")
    named = rows.filter("id is not null")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")]
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(*marked)
    placed = named.join(first, ["id", "digest"], "left").join(marks, "id", "left")
    repeats = F.when(F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    known = placed.select("part", (F.col("mask") + repeats).alias("mask"), "docs", "quality", "toxic")
    unknown = rows.filter("id is null").select("part", "mask", "docs", F.lit(False).alias("quality"), F.lit(False).alias("toxic"))
    both = known.unionByName(unknown)
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("docs"))), F.lit(0))
    return both.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), count("quality").alias("good"), count("toxic").alias("toxic"))


def _named(**fields: Column) -> Column:
    """A struct whose names hold inside higher-order functions too, where aliases are lost."""
    return F.named_struct(*[part for name, field in fields.items() for part in (F.lit(name), field)])


def _steps(cell: Column, orders: Column) -> Column:
    """One struct of counts per order and step: a fold along each order that knows whether the cell is gone already."""
    none = F.lit(0).cast("bigint")

    def along(order: Column) -> Column:
        def step(done: Column, bit: Column) -> Column:
            fails = cell["mask"].bitwiseAND(bit) != 0
            removed = fails & ~done["gone"]
            counts = {
                "kept": F.when(~fails & ~done["gone"], cell["docs"]),
                "removed": F.when(removed, cell["docs"]),
                "redundant": F.when(fails & done["gone"], cell["docs"]),
                "unique_fails": F.when(cell["mask"] == bit, cell["docs"]),
                "good_lost": F.when(removed, cell["good"]),
                "toxic_lost": F.when(removed, cell["toxic"]),
            }
            row = _named(**{c: F.coalesce(counts[c], none) for c in COUNTS})
            return _named(gone=done["gone"] | fails, steps=F.array_append(done["steps"], row))

        steps = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
        start = _named(gone=F.lit(False), steps=F.array().cast(steps))
        return F.aggregate(order, start, step, lambda done: done["steps"])

    return F.flatten(F.transform(orders, along))


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """cells(part, mask, docs, good, toxic) to one row per part, order of the letters and step.

    Bit i of a mask is the filter letters[i]. A row counts what its filter keeps, removes, would have removed, fails alone, and
    takes from the labelled rows; shapley is what the filter removes over all orders. A part has at most 2 ** n cells, so no
    group is collected that grows with the documents.
    """
    n, names = len(letters), ["".join(p) for p in permutations(letters)]
    orders = F.split(F.lit(" ".join(names)), " ")  # one constant; an array of hundreds of them would slow the planner down
    bits = F.transform(orders, lambda o: F.transform(F.split(o, ""), lambda c: F.pow(F.lit(2), F.instr(F.lit(letters), c) - 1).cast("int")))
    zero = F.array_repeat(_named(**dict.fromkeys(COUNTS, F.lit(0).cast("bigint"))), n * len(names))
    summed = cells.groupBy("part", F.col("mask").cast("int").alias("mask")).agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))
    add = lambda a, b: _named(**{c: a[c] + b[c] for c in COUNTS})
    merged = F.aggregate("cells", zero, lambda total, cell: F.zip_with(total, _steps(cell, bits), add))
    rows = parts.select("part", F.posexplode(merged).alias("at", "counts")).select("part", "at", "counts.*")
    order = F.get(orders, F.floor(F.col("at") / n).cast("int"))
    rows = rows.withColumn("filter_order", order).withColumn("step", (F.col("at") % n + 1).cast("int"))
    rows = rows.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    over = F.sum("removed").over(W.partitionBy("part", "letter"))  # one row per order
    return rows.select("part", "filter_order", "step", *COUNTS, over.alias("shapley"))
