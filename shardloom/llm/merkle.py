"""A hash tree over a dataset: every row gets its leaf, the proof that leads from it to the root, and a check of that proof.

Leaves ascend by doc_id inside a source. While several nodes remain, every FAN consecutive ones become the hash of their
digests; what remains is the source's subroot, and the subroots, ordered by source, are the leaves of a tree of the same kind.

A run of FAN ** LOCAL consecutive leaves is a superblock. Leaves are first reduced to one node per superblock, and only these,
hundreds of times fewer, are carried up level by level in written tables. Down again, each node inherits the siblings of its
ancestors. At the end the leaves of a superblock and the outer nodes that its proofs need meet in one cogrouped call that
finishes the local reduction, joins the proofs and folds them. No group holds more than FAN ** LOCAL rows and FAN siblings per
level, whatever share of the rows a source has.

Nulls: a null field is hashed as `-`; a null source comes before all others and is not the empty one; a null doc_id comes
first. Rows with one doc_id are ordered by leaf; equal rows have equal leaves, each at a place of its own with a proof of its
own. Texts of any length are hashed whole where they are read. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import lower_ascii, send
from shardloom.operators.prefix import ordered_index
from shardloom.session import stage

FAN = 16
LOCAL = 2  # levels inside a superblock
OUTER = 100  # depths from here on are those of the tree over the subroots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROVEN = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """The hash of values in order, each with its length so that no two rows of fields are spelled alike."""
    parts = []
    for field in fields.values():
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered(fields: dict[str, Column]) -> dict[str, Column]:
    """The alteration that the proofs are tried on: lower-case text."""
    return fields | {"text": lower_ascii(fields["text"])}


def leaves(docs: DataFrame) -> DataFrame:
    """name (of the source, null-safe, in the order of the sources), doc_id, leaf, and altered, null for rows left alone."""
    fields = {c: F.col(c) for c in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(leaf(fields)).alias("leaf"),
        F.when(chosen, F.unhex(leaf(tampered(fields)))).alias("altered"),
    )


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """nodes(name, at, node) to all levels of runs: name, up, run (FAN neighbours in order), single if nothing else remains.

    A run of one node that is the first of its name is what remains of the name. Each level is written, a FAN-th of the one below.
    """
    levels = []
    while True:
        run = F.transform(F.sort_array(F.collect_list(F.struct("at", "node"))), lambda r: r["node"])
        runs = nodes.groupBy("name", F.floor(F.col("at") / FAN).alias("up")).agg(run.alias("run"))
        levels.append(stage(runs.withColumn("single", (F.col("up") == 0) & (F.size("run") == 1)), "merkle-runs"))
        rest = levels[-1].filter("not single")
        if rest.isEmpty():
            return levels
        texts = F.array_join(F.transform("run", lambda node: F.lower(F.hex(node))), "")
        nodes = rest.select("name", F.col("up").alias("at"), F.unhex(F.sha2(texts.cast("binary"), 256)).alias("node"))


def _descend(levels: list[DataFrame], above: DataFrame, depth: int) -> DataFrame:
    """For each node of the lowest level the way from there to the root: name, at, path.

    `above`(name, path) holds what the tops of the trees inherit. path is an array of (depth, place, run): at that level the
    run's nodes in order, and the place of the ancestor among them.
    """
    paths = None
    for i, runs in reversed(list(enumerate(levels))):
        made = runs.filter("single").join(above, "name").select("name", F.col("up").alias("at"), "path")
        if paths is not None:
            parents = runs.filter("not single").join(paths.withColumnRenamed("at", "up"), ["name", "up"])
            placed = parents.select("*", F.explode(F.sequence(F.lit(0), F.size("run") - 1)).alias("place"))
            own = F.struct(F.lit(depth + i).alias("depth"), "place", "run")
            made = made.unionByName(placed.select("name", (F.col("up") * FAN + F.col("place")).alias("at"), F.concat(F.array(own), "path").alias("path")))
        paths = stage(made, "merkle-paths")
    return paths


def outer_paths(tops: DataFrame) -> DataFrame:
    """tops(name, at, node), one per superblock, to name, at, path: entries inside a source have a depth below OUTER."""
    inner = _climb(tops)
    subroots = inner[0].filter("single")
    for level in inner[1:]:
        subroots = subroots.unionByName(level.filter("single"))
    subroots = stage(subroots.select(F.lit("").alias("all"), "name", F.get("run", F.lit(0)).alias("node")), "merkle-subroots")
    ranked = ordered_index(subroots, ["all"], ["name"], "rank", lambda df: stage(df, "merkle-ranks"))
    outer = _climb(ranked.select(F.col("all").alias("name"), F.col("rank").alias("at"), "node"))
    kind = "array<struct<depth:int,place:int,run:array<binary>>>"
    start = tops.sparkSession.range(1).select(F.lit("").alias("name"), F.array().cast(kind).alias("path"))
    over = _descend(outer, start, OUTER).join(ranked.select(F.col("rank").alias("at"), F.col("name").alias("of")), "at")
    return _descend(inner, stage(over.select(F.col("of").alias("name"), "path"), "merkle-above"), 0)


def _reduce(nodes: list[str], levels: int) -> list[list[list[str]]]:
    """The runs of each of `levels` levels, and at last the nodes that remain."""
    made = []
    for _ in range(levels):
        runs = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
        made.append(runs)
        nodes = [_digest(*run) for run in runs]
    return [*made, [nodes]]


def _inside(rows: pd.DataFrame) -> tuple[list[str], list[list[list[str]]], str]:
    """Leaves of a superblock, the runs of its levels, and its top.

    Only the first superblock of a source can be short of LOCAL levels, and then it is the whole source.
    """
    nodes = [bytes(b).hex() for b in rows["leaf"]]
    levels = LOCAL
    if rows["block"].iloc[0] == 0:
        levels = next(h for h in range(LOCAL + 1) if FAN**h >= len(nodes))
    runs = _reduce(nodes, levels)
    return nodes, runs[:-1], runs[-1][0][0]


def _superblock_top(rows: pd.DataFrame) -> pd.DataFrame:
    _, _, top = _inside(rows.sort_values("at"))
    return pd.DataFrame({"name": [rows["name"].iloc[0]], "at": [int(rows["block"].iloc[0])], "node": [bytes.fromhex(top)]})


def _prove(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Leaves of one superblock and its outer nodes: proofs joined from both, and folded from what each row is now."""
    rows = rows.sort_values("at")
    nodes, inside, top = _inside(rows)
    shared = []  # what all leaves of the superblock have in common: text left and right of the ancestor, level by level
    for step, place, run in zip(outer["depth"], outer["place"], outer["run"], strict=True):
        digests = [bytes(b).hex() for b in run]
        shared.append((step, "".join(digests[:place]), "".join(digests[place + 1 :])))
    shared.sort()
    subroot = root = top
    for step, left, right in shared:
        root = _digest(left, root, right)
        subroot = root if step < OUTER else subroot
    common = "".join(left + right for _, left, right in shared)
    made = {"proof_sha256": [], "folded_root": []}
    for i, altered in enumerate(rows["altered"]):
        node = nodes[i] if altered is None else altered.hex()
        near, k = [], i
        for runs in inside:
            run, place = runs[k // FAN], k % FAN
            left, right = "".join(run[:place]), "".join(run[place + 1 :])
            near += (left, right)
            node = _digest(left, node, right)
            k //= FAN
        for _, left, right in shared:
            node = _digest(left, node, right)
        made["proof_sha256"].append(_digest(*near, common))
        made["folded_root"].append(node)
    out = pd.DataFrame({"doc_id": rows["doc_id"], "leaf": nodes, "subroot": subroot, "root": root})
    return out.assign(**{c: pd.array(v, "object") for c, v in made.items()})


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the row as it is now) and verified, one row per document."""
    send(__name__)
    stored = stage(leaves(docs).withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    order = ["doc_id", "leaf", "tie"]  # the tie lets equal rows spread over tasks
    placed = ordered_index(stored, ["name"], order, "at", lambda df: stage(df, "merkle-order"))
    placed = placed.select("name", F.floor(F.col("at") / FAN**LOCAL).alias("block"), "at", F.col("doc_id").cast("string"), "leaf", "altered")
    tops = placed.groupBy("name", "block").applyInPandas(_superblock_top, "name string, at bigint, node binary")
    paths = outer_paths(stage(tops, "merkle-tops"))
    outer = paths.select("name", F.col("at").alias("block"), F.inline("path"))
    proven = placed.groupBy("name", "block").cogroup(outer.groupBy("name", "block")).applyInPandas(_prove, PROVEN)
    columns = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    return proven.select(F.col("doc_id").cast("bigint"), *columns, (F.col("folded_root") == F.col("root")).alias("verified"))
