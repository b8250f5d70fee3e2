"""Secret scans: base rules, and strings that look random to character Markov models.

Only DataFrame functions run. Two first-order models over the characters of keys are trained, one on strings that the base
rules label as secrets, one on ordinary words; a long run of such characters is a secret if its log-likelihood ratio per
step is over a threshold. Offsets are code points, ends exclusive.

Nulls: a null text is empty and has no spans. Rows that repeat are answered alike, null doc_ids are kept, an empty table
gives no rows. Without labelled secrets the random model is uniform. Long texts cost linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shardloom.llm.common import sha256_hex

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Runs too short to be looked at; the others are what is to be told apart, so they have no label.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{0,18}(?![A-Za-z0-9+/_=-])"
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which spans with one start are listed; a run of at least so many is the same as a run that is long enough.
KINDS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}", "random": RUN}
BASE = ("assign", "access", "hex")
SHORTEST_VALUE = 6
#: Labelled samples: so many documents with base matches, and so many of any kind, those with the smallest hashed ids.
SAMPLE_DOCS = 2_000
THRESHOLD = 1.0  # nats per step
SMOOTHING, BACK_OFF = 0.5, 5.0


def _passes(kind: str, match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= SHORTEST_VALUE if kind == "assign" else F.lit(True)


def _sample(docs: DataFrame) -> DataFrame:
    return docs.filter("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(SAMPLE_DOCS)


def _steps(strings: DataFrame) -> DataFrame:
    """Counts of character pairs: at most the square of the alphabet."""
    n = F.length("s")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))
    return strings.filter(n >= 2).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of all steps between characters, random over ordinary, row by row of ALPHABET.

    Both samples are bounded by SAMPLE_DOCS, and only counts of character pairs reach the driver. Half of the random
    model's weight is uniform, because the labelled secrets are few and use few characters.
    """
    narrow = docs.select("doc_id", "text")
    any_base = F.col("text").rlike(KINDS["assign"]) | F.col("text").rlike(KINDS["access"]) | F.col("text").rlike(KINDS["hex"])
    secrets = _sample(narrow.filter(any_base)).select(
        F.explode(
            F.concat(
                F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)),
                F.regexp_extract_all("text", F.lit(KINDS["access"]), F.lit(0)),
                F.regexp_extract_all("text", F.lit(KINDS["hex"]), F.lit(0)),
            )
        ).alias("s")
    )
    secrets = secrets.filter(F.length("s") >= 16).select(F.regexp_replace("s", r"[^A-Za-z0-9+/_=-]", "").alias("s"))
    plain = F.regexp_replace("text", "|".join(KINDS[k] for k in BASE), " ")
    words = _sample(narrow).select(F.explode(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0))).alias("s"))
    random, ordinary = ({r.pair: r.n for r in _steps(s).collect()} for s in (secrets, words))
    seen, usual = _probabilities(random), _probabilities(ordinary)
    return [math.log(0.5 * r + 0.5 / len(ALPHABET)) - math.log(o) for r, o in zip(seen, usual, strict=True)]


def _probabilities(pairs: dict[str, int]) -> list[float]:
    """Chances of each character after each other, row by row; rare rows lean on how frequent the character is at all."""
    single = {b: sum(pairs.get(a + b, 0) for a in ALPHABET) + SMOOTHING for b in ALPHABET}
    total = sum(single.values())
    table = []
    for a in ALPHABET:
        row = sum(pairs.get(a + b, 0) for b in ALPHABET)
        table += [(pairs.get(a + b, 0) + BACK_OFF * single[b] / total) / (row + BACK_OFF) for b in ALPHABET]
    return table


def ratio(run: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of a run's steps."""
    size = len(ALPHABET)
    steps = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = F.size(codes) - 1
    values = F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.get(steps, a * size + b))
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / n


def _entry(kind: str, number: int, skip: Column, table: list[float]):
    """A part of the text before a match, and the match; the last part has none."""

    def entry(both: Column, i: Column) -> Column:
        gap, match = both.getField("0"), both.getField("1")
        fine = ratio(match, table) > THRESHOLD if kind == "random" else _passes(kind, match)
        return F.struct(
            F.lit(number).alias("kind"),
            i.alias("at"),
            F.length(gap).cast("bigint").alias("gap"),
            F.coalesce(F.length(match), F.lit(0)).cast("bigint").alias("size"),
            (skip * F.length("_text")).cast("bigint").alias("skip"),
            F.when(match.isNotNull(), fine).otherwise(False).alias("fine"),
        )

    return entry


def find(docs: DataFrame, table: list[float]) -> DataFrame:
    """doc_id, _row and spans, array<struct<start, kind, end>> in order, kinds numbered as in KINDS.

    Texts stay beside the scan: for each kind they are split at its matches, and the lengths of the parts, a narrow row
    each, are summed up by a window over the document.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    has = {kind: F.col("_text").rlike(pattern) for kind, pattern in KINDS.items()}
    arrays, skip = [], F.lit(0)
    part = "array<struct<kind: int, at: int, gap: bigint, size: bigint, skip: bigint, fine: boolean>>"
    for number, (kind, pattern) in enumerate(KINDS.items()):
        matches = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        both = F.arrays_zip(F.split("_text", pattern, -1), matches)
        entries = F.transform(both, _entry(kind, number, skip, table))
        arrays.append(F.when(has[kind], entries).otherwise(F.array().cast(part)))
        skip = skip + has[kind].cast("bigint")
    parts = rows.select("doc_id", "_row", F.inline_outer(F.concat(*arrays)))
    upto = W.partitionBy("_row").orderBy("kind", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto) - F.col("skip"))
    span = F.when(F.col("fine"), F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))
    spans = placed.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("_all"))
    base = F.filter("_all", lambda s: s["kind"] < len(BASE))
    free = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return spans.withColumn("_base", base).select(
        "doc_id", "_base", F.filter("_all", lambda s: (s["kind"] < len(BASE)) | free(s)).alias("spans")
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans of each document."""
    found = find(docs, train(docs))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == BASE.index(kind))).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        sha256_hex(_listed(F.col("_base"))).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
