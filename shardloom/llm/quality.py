"""Quality rules: counts over words and lines, and a logistic regression on hashed word and character n-grams.

The regression is trained on labelled rows, its scores become probabilities by a second, two-parameter regression on
rows it has not seen, and texts are scored in Arrow batches against a fixed threshold.

Nulls: a null text is empty and fails the base rules; labels without quality or doc_id are left out; a document with
several labels counts by its lowest. Without labels of both kinds there is no model, and the base rules alone decide.
Rows that repeat are judged alike; an empty table gives no rows; other columns are carried along by `keep`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import send

BITS = 11  # of a hash: 2,048 weights for each of the three families
FAMILIES = 3
#: Labelled rows of each class that training takes, those with the smallest hashed ids.
TRAINING_ROWS = 1_000
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words
CHUNK = 1 << 20  # bytes hashed at a time
SYMBOLS = b"#*$%&|<>"
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # FAMILIES x 2 ** BITS
    bias: float
    slope: float
    shift: float


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family (words, word pairs, three bytes) the buckets of all n-grams, and the text each is from."""
    sizes = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    owner_end = np.cumsum(sizes + 1)
    letter = ~_SPACE[data]
    first = letter & ~np.concatenate(([False], letter[:-1]))
    starts = np.flatnonzero(first)
    empty = np.empty(0, np.int64)
    if not len(starts):
        return [(empty, empty)] * FAMILIES
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if at is None:
        at = np.concatenate((np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))))
    letters = np.where(letter, data, 0).astype(np.uint64) * _POWERS[at & 4095]
    words = np.add.reduceat(letters, starts)
    owner = np.searchsorted(owner_end, starts, side="right")
    pairs = words[:-1] * np.uint64(0x94D049BB133111EB) + words[1:]
    paired = owner[:-1] == owner[1:]
    wide = data.astype(np.uint64)
    three = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
    byte_owner = np.repeat(np.arange(len(raws)), sizes + 1)
    inside = byte_owner[:-2] == byte_owner[2:]
    return [
        (_bucket(words), owner),
        (_bucket(pairs[paired]), owner[:-1][paired]),
        (_bucket((three[inside] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), byte_owner[:-2][inside]),
    ]


def _chunks(raws: list[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for raw in raws:
        if chunk and size + len(raw) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(raw)
        size += len(raw)
    if chunk:
        yield chunk


def scores(model: Model, raws: list[bytes]) -> np.ndarray:
    """Raw scores: for each family the mean weight of a text's n-grams."""
    found = []
    for chunk in _chunks(raws):
        total = np.full(len(chunk), model.bias)
        for weights, (buckets, owner) in zip(model.weights, ngrams(chunk), strict=True):
            n = np.bincount(owner, minlength=len(chunk))
            total += np.bincount(owner, weights[buckets], len(chunk)) / np.maximum(n, 1)
        found.append(total)
    return np.concatenate(found) if found else np.empty(0)


def profile(raw: bytes) -> np.ndarray:
    """A text's share of n-grams in each bucket, family by family."""
    shares = [np.bincount(buckets, minlength=1 << BITS) / max(len(buckets), 1) for buckets, _ in ngrams([raw])]
    return np.concatenate(shares).astype(np.float32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the weighted logistic loss; products are taken in x's own type, so x is not copied."""
    step = 4.0 / max(float(weight @ (1 + np.einsum("ij,ij->i", x, x))), 1e-9)
    w, vw, b, vb = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    for k in range(rounds):
        error = weight * (_logistic(x @ vw.astype(x.dtype) + vb) - y)
        nw, nb = vw - step * (x.T @ error.astype(x.dtype) + ridge * vw), vb - step * error.sum()
        speed = k / (k + 3)
        vw, vb, w, b = nw + speed * (nw - w), nb + speed * (nb - b), nw, nb
    return w, float(b)


def fit(profiles: np.ndarray, good: np.ndarray, prior: float, ridge: float = 1e-2, rounds: int = 200) -> Model | None:
    """Three rows of four train the weights, with both kinds weighing the same; the fourth trains the probabilities.

    prior: the share of good rows among all labels, by which the calibration rows are weighted.
    """
    if not 0 < good.sum() < len(good):
        return None
    held = np.arange(len(good)) % 4 == 3
    if any((good[part] == kind).sum() < 2 for part in (held, ~held) for kind in (0, 1)):
        held = np.ones(len(good), bool)  # too few of a kind: the same rows serve both
        train = held
    else:
        train = ~held
    x, y = profiles[train], good[train].astype(np.float64)
    mean = x.mean(0, dtype=np.float64)
    x -= mean.astype(x.dtype)
    spread = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)).astype(np.float64) + 1e-4
    x /= spread.astype(x.dtype)
    w, b = _descend(x, y, np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()), ridge, rounds)
    del x
    weights = w / spread
    model = Model(weights.reshape(FAMILIES, -1), b - float(mean @ weights), 1.0, 0.0)

    raw = profiles[held] @ weights + model.bias
    y = good[held].astype(np.float64)
    kinds = np.where(y > 0, prior / y.sum(), (1 - prior) / (1 - y).sum())
    aim = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    centre, scale = raw.mean(), raw.std() + 1e-9
    slope, shift = _descend(((raw - centre) / scale)[:, None], aim, kinds, 0.0, 500)
    slope = float(slope[0]) / scale
    return Model(model.weights, model.bias, slope, shift - slope * centre)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model | None:
    """Fit on at most `rows` labelled documents of each kind, those with the smallest hashed ids.

    That sample is the only thing that is bounded: profiles of 2 * rows documents, 24 kB each, reach the driver.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r.quality: r.n for r in known.groupBy((F.col("quality") > 0).cast("int").alias("quality")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    order = [F.xxhash64(F.col("doc_id").cast("bigint")), F.col("doc_id")]
    kinds = [known.filter(kind).orderBy(*order).limit(rows) for kind in ("quality > 0", "quality <= 0")]
    sample = kinds[0].union(kinds[1]).select(F.col("doc_id").alias("_labelled"), F.col("quality").alias("_quality"))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled")).select("doc_id", "_quality", "text")
    send(__name__)

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [profile((t.as_py() or "").encode()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "quality", "profile"])

    found = texts.selectExpr("cast(doc_id as bigint) doc_id", "cast(_quality as int) quality", "text")
    found = found.mapInArrow(profiles, "doc_id bigint, quality int, profile binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["doc_id", "profile"]).iloc[np.random.default_rng(0).permutation(len(found))]
    good = found["quality"].to_numpy() > 0
    matrix = np.stack([np.frombuffer(p, np.float32) for p in found["profile"]])
    del found  # the driver holds the sample once, and once more the rows that are trained on
    return fit(matrix, good, n[1] / (n[0] + n[1]))


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    threes = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(threes)) < len(threes):
        often = {three for three, n in Counter(threes).items() if n > 1}
        covered = 0  # end of the words that are counted
        for i, three in enumerate(threes):
            if three in often:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = ", ".join(f"{c} bigint" for c in COUNTS) + ", probability double, base_failed boolean, kept boolean"


def judge(texts: pa.Array, model: Model | None) -> list[pa.Array]:
    """The columns of RESULT for a batch of texts."""
    plain = [t or "" for t in texts.to_pylist()]
    table = np.array([counts(t) for t in plain], np.int64).reshape(-1, len(COUNTS))
    failed = (table[:, 0] < MIN_WORDS) | (100 * table[:, 4] > MAX_REPEATED * table[:, 0])
    if model is None:
        chance = pa.nulls(len(plain), pa.float64())
        kept = ~failed
    else:
        p = _logistic(model.slope * scores(model, [t.encode() for t in plain]) + model.shift)
        chance, kept = pa.array(p), ~failed & (p >= THRESHOLD)
    return [*(pa.array(c) for c in table.T), chance, pa.array(failed), pa.array(kept)]


def assess(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id with counts, the probability of good quality (null without a model), base_failed and kept."""
    send(__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f.split()[0] for f in RESULT.split(", "))]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *judge(batch.column(1), model)], names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, f"doc_id bigint, {RESULT}")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that pass, with all their columns; a map over batches, so nothing is shuffled."""
    send(__name__)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(judge(batch.column(batch.schema.get_field_index("text")), model)[-1])

    return docs.mapInArrow(passes, docs.schema)
