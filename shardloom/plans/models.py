"""Queries on byte-pair encoding and on language models counted from the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.text import EOS, byte_level_words, bytes_to_text, digest, words, wrap
from shardloom.operators import bpe, corpus_lm, encode, ordering, packing
from shardloom.operators.prefix import ordered_index
from shardloom.plans import tables
from shardloom.plans.registry import query
from shardloom.plans.sql import TOKENS, packed, shuffled
from shardloom.plans.tables import CHUNK_DOCS, LENGTH, stager, stored
from shardloom.session import new_path, stage
from shardloom.sources import readers

BPE_VOCAB = 256  # the small form, as far as the SQL can follow
BPE_FULL = 30_000  # the trainer's own default; these queries have no SQL
BUDGETS = [1_024, 4_096, 16_384, 0]  # 0: all tokens
SOURCE_LANG = "en"
_TRAINED: dict[tuple[str, str, int], tuple] = {}


def _trained(spark: SparkSession, sf_dir: str, size: int = BPE_VOCAB) -> tuple[list[str], list[tuple[str, str]], DataFrame]:
    """Pieces, merges and segmented words over the text of all splits."""
    key = (spark.sparkContext.applicationId, sf_dir, size)
    if key not in _TRAINED:
        counts = encode.word_counts(tables.documents(spark, sf_dir))
        pieces, merges, segmented = bpe.train(counts, stager(f"bpe-{size}"), vocab_size=size)
        _TRAINED[key] = pieces, merges, stage(segmented, "segmented")
    return _TRAINED[key]


# One state row per merge: the pieces so far and every word, a character per symbol as chr(65536 + id).
_BPE = f"""{TOKENS},
words AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tokens) WHERE token <> '{EOS}' GROUP BY token),
letters AS (SELECT list(DISTINCT c ORDER BY c) AS pieces FROM (SELECT unnest(string_split(token, '')) AS c FROM words)),
spelled AS (
  SELECT token, n, array_to_string(list_transform(string_split(token, ''), lambda c: chr(65535 + list_position(pieces, c)::INT)), '') AS symbols
  FROM words CROSS JOIN letters),
state AS (
  SELECT 0 AS k, pieces, NULL::VARCHAR AS a, NULL::VARCHAR AS b, s.symbols, s.counts
  FROM letters CROSS JOIN (SELECT list(symbols ORDER BY token) AS symbols, list(n ORDER BY token) AS counts FROM spelled) s
  UNION ALL
  SELECT k + 1, CASE WHEN list_contains(pieces, x || y) THEN pieces ELSE list_append(pieces, x || y) END, x, y,
         list_transform(symbols, lambda w: replace(w, pair, chr(65535 + coalesce(nullif(list_position(pieces, x || y), 0), len(pieces) + 1)::INT))), counts
  FROM (
    SELECT s.*, pair, pieces[ord(pair[1]) - 65535] AS x, pieces[ord(pair[2]) - 65535] AS y
    FROM state s CROSS JOIN (
      SELECT pair FROM (SELECT n, w[i:i + 1] AS pair FROM (
        SELECT n, w, unnest(range(1, len(w))) AS i FROM (SELECT unnest(symbols) AS w, unnest(counts) AS n FROM state)))
      GROUP BY pair ORDER BY sum(n) DESC, pair LIMIT 1)
    WHERE len(pieces) < {BPE_VOCAB}))"""


@query(f"""WITH RECURSIVE {_BPE} SELECT (k - 1)::BIGINT AS merge_no, a AS "left", b AS "right" FROM state WHERE k > 0""")
def train_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merges(spark, sf_dir, BPE_VOCAB)


@query()
def train_bpe_30k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merges(spark, sf_dir, BPE_FULL)


def _merges(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    _, merges, _ = _trained(spark, sf_dir, size)
    rows = [(i, left, right) for i, (left, right) in enumerate(merges)]
    return spark.createDataFrame(rows, "merge_no bigint, left string, right string")


def _bpe_ids(spark: SparkSession, sf_dir: str, size: int = BPE_VOCAB) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", words("text").alias("tokens"))
    return bpe.encode_pieces(docs, ["doc_id"], _trained(spark, sf_dir, size)[2])


@query(f"""WITH RECURSIVE {_BPE},
ids AS (
  SELECT unnest((SELECT list(token ORDER BY token) FROM spelled)) AS token, unnest(symbols) AS word
  FROM state WHERE k = (SELECT max(k) FROM state)),
pieced AS (SELECT token, len(word) AS n, array_to_string(list_transform(string_split(word, ''), lambda c: ord(c) - 65536), ' ') AS ids FROM ids)
SELECT doc_id, (coalesce(sum(n), 0) + 2)::BIGINT AS n_ids,
       md5(concat_ws(' ', {BPE_VOCAB + 1}, string_agg(ids, ' ' ORDER BY i), {BPE_VOCAB + 1})) AS digest
FROM (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM tokens) t LEFT JOIN pieced USING (token)
GROUP BY doc_id""")
def encode_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, BPE_VOCAB)


@query()
def encode_bpe_30k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, BPE_FULL)


def _encoded(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    vocab = bpe.tokenizer_vocab(_trained(spark, sf_dir, size)[0])
    ids = wrap("ids", F.lit(vocab[EOS]).cast("bigint"))
    docs = _bpe_ids(spark, sf_dir, size).withColumn("ids", ids)
    return docs.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), digest("ids").alias("digest"))


@query(f"""WITH RECURSIVE {_BPE},
last AS (SELECT pieces, symbols FROM state WHERE k = (SELECT max(k) FROM state)),
segmented AS (SELECT unnest((SELECT list(token ORDER BY token) FROM spelled)) AS token, unnest(symbols) AS word, pieces FROM last),
pieced AS (SELECT token, array_to_string(list_transform(string_split(word, ''), lambda c: pieces[ord(c) - 65535]), ' ') AS text FROM segmented)
SELECT doc_id, md5(coalesce(string_agg(text, ' ' ORDER BY i), '')) AS digest
FROM (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM tokens) t LEFT JOIN pieced USING (token)
GROUP BY doc_id""")
def decode_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with spaces between, as a tokenizer without a decoder puts them together."""
    return _decoded(spark, sf_dir, BPE_VOCAB)


@query()
def decode_bpe_30k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, BPE_FULL)


def _decoded(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    pieces = bpe.piece_table(spark, _trained(spark, sf_dir, size)[0])
    text = bpe.decode_pieces(_bpe_ids(spark, sf_dir, size), ["doc_id"], pieces, joiner=" ")
    return text.select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def byte_level_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level pieces are learned and stored as vocabulary and merges files; with these, texts are encoded and decoded."""
    return _byte_level(spark, sf_dir, BPE_VOCAB).select("doc_id", "digest")


@query()
def byte_level_bpe_30k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the full vocabulary, and the number and digest of the ids of every text."""
    return _byte_level(spark, sf_dir, BPE_FULL)


def _byte_level(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", byte_level_words("text").alias("tokens"))
    counts = stage(docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "byte-words")
    pieces, merges, _ = bpe.train(counts, stager(f"byte-bpe-{size}"), vocab_size=size)
    vocab_path, merges_path = new_path(spark, "byte-vocab"), new_path(spark, "byte-merges")
    bpe.save_vocab_and_merges(spark, vocab_path, merges_path, pieces, merges)
    ids = {r.token: r.id for r in readers.read_vocab_json(spark, vocab_path).collect()}
    stored_merges = [(r.left, r.right) for r in readers.read_merges(spark, merges_path).orderBy("merge_no").collect()]
    segmented = stage(bpe.segment(counts, stored_merges, ids).join(counts, "token"), "byte-segmented")
    encoded = bpe.encode_pieces(docs, ["doc_id"], segmented)
    table = bpe.piece_table(spark, sorted(ids, key=ids.get))
    numbered = encoded.select("*", F.size("ids").cast("bigint").alias("n_ids"), digest("ids").alias("ids_digest"))
    text = bpe.decode_pieces(numbered, ["doc_id", "n_ids", "ids_digest"], table)
    return text.select("doc_id", "n_ids", "ids_digest", F.md5(bytes_to_text("text")).alias("digest"))


_MODEL = """
pairs AS (SELECT split, {key} block_no, tokens[i] AS y, tokens[i + 1] AS x
          FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM blocks))"""


@query(f"""WITH {TOKENS}, {shuffled()},
{packed("stream, shard", "chunk, md5(concat_ws('|', 0, shard, doc_no))", "shuffled").replace("blocks AS", "all_blocks AS")},
blocks AS (SELECT b.*, s.split FROM all_blocks b JOIN shards s USING (shard)),
{_MODEL.format(key="shard,")},
c1 AS (SELECT x, count(*) AS c1 FROM (SELECT unnest(tokens) AS x FROM blocks WHERE split = 'train') GROUP BY x),
c2 AS (SELECT y, x, count(*) AS c2 FROM pairs WHERE split = 'train' GROUP BY y, x),
ctx AS (SELECT y, sum(c2) AS ctx FROM c2 GROUP BY y),
size AS (SELECT sum(c1) AS total, count(*) AS kinds FROM c1),
smooth AS (
  SELECT p.split, p.shard, p.block_no, (coalesce(c1, 0) + 1)::DOUBLE / (total + kinds + 1) AS p1, c2, ctx
  FROM pairs p CROSS JOIN size LEFT JOIN c1 USING (x) LEFT JOIN ctx USING (y) LEFT JOIN c2 USING (y, x) WHERE p.split <> 'train')
SELECT split, shard, block_no,
       round(avg(-ln(CASE WHEN ctx > 0 THEN 0.5::DOUBLE * coalesce(c2, 0) / ctx + 0.5::DOUBLE * p1 ELSE p1 END)), 6) AS loss
FROM smooth GROUP BY split, shard, block_no""")
def lm_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every held-out block under a model counted from the train split, on token ids."""

    def build() -> DataFrame:
        docs = ordering.shuffle_docs(tables.encoded(spark, sf_dir), F.lit(0), CHUNK_DOCS)
        blocks = packing.pack(docs, ["split", "shard"], ["shuffle_key"], LENGTH, tokens="ids")
        return blocks.select("split", "shard", "block_no", "tokens")

    losses = corpus_lm.block_losses(stored(spark, sf_dir, "lm-blocks", build), ["split", "shard", "block_no"], stage)
    return losses.select("split", "shard", "block_no", F.round("loss", 6).alias("loss"))


def language_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per language and split, documents in doc_id order: a language's split is one long file."""

    def build() -> DataFrame:
        docs = tables.tokens(spark, sf_dir).drop("doc_no")
        scope = ["lang", "split"]
        numbered = ordered_index(docs.select(*scope, "doc_id"), scope, ["doc_id"], "doc_no", stager("language-docs"))
        placed = ordering.place_in_chunks(docs.join(numbered, [*scope, "doc_id"]))
        return packing.pack(placed, scope, ["doc_no"], LENGTH).drop("trigger")

    return stored(spark, sf_dir, "language-blocks", build)


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: corpus_lm.transfer_losses(language_blocks(spark, sf_dir), SOURCE_LANG, BUDGETS, LENGTH, stage)
    return stored(spark, sf_dir, "transfers", build)


_TRANSFERS = f"""{TOKENS}, in_order AS (SELECT *, 0 AS doc_i FROM tokens),
{packed("lang, split", "doc_id", "in_order")},
{_MODEL.format(key="lang,")},
models AS (
  SELECT lang, budget, init FROM (SELECT DISTINCT lang FROM blocks WHERE lang <> '{SOURCE_LANG}')
  CROSS JOIN (SELECT unnest({BUDGETS}) AS budget) CROSS JOIN (SELECT unnest(['scratch', 'pretrained']) AS init)),
seen AS (
  SELECT m.lang, m.budget, m.init, b.lang = m.lang AS own, b.tokens FROM models m JOIN blocks b ON b.split = 'train' AND (
    (b.lang = m.lang AND (m.budget <= 0 OR b.block_no < m.budget // {LENGTH})) OR (m.init = 'pretrained' AND b.lang = '{SOURCE_LANG}'))),
counted AS (SELECT lang, budget, init, coalesce(sum(len(tokens)) FILTER (WHERE own), 0)::BIGINT AS n_tokens FROM seen GROUP BY ALL),
c1 AS (SELECT lang, budget, init, x, count(*) AS c1 FROM (SELECT lang, budget, init, unnest(tokens) AS x FROM seen) GROUP BY ALL),
c2 AS (SELECT lang, budget, init, tokens[i] AS y, tokens[i + 1] AS x, count(*) AS c2
       FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM seen) GROUP BY ALL),
ctx AS (SELECT lang, budget, init, y, sum(c2) AS ctx FROM c2 GROUP BY ALL),
size AS (SELECT lang, budget, init, sum(c1) AS total, count(*) AS kinds FROM c1 GROUP BY ALL),
scored AS (SELECT lang, split, y, x, count(*) AS n FROM pairs WHERE split <> 'train' GROUP BY ALL),
rated AS (
  SELECT m.lang, s.split, m.budget, m.init, n, (coalesce(c1, 0) + 1)::DOUBLE / (total + kinds + 1) AS p1, c2, ctx
  FROM scored s JOIN models m USING (lang) JOIN size USING (lang, budget, init)
  LEFT JOIN c1 USING (lang, budget, init, x) LEFT JOIN ctx USING (lang, budget, init, y) LEFT JOIN c2 USING (lang, budget, init, y, x)),
losses AS (
  SELECT lang, split, budget, init, n_tokens,
         sum(n * -ln(CASE WHEN ctx > 0 THEN 0.5::DOUBLE * coalesce(c2, 0) / ctx + 0.5::DOUBLE * p1 ELSE p1 END)) / sum(n) AS loss
  FROM rated JOIN counted USING (lang, budget, init) GROUP BY lang, split, budget, init, n_tokens)"""


@query(f"WITH {_TRANSFERS} SELECT lang, split, budget::BIGINT AS budget, init, n_tokens, round(loss, 6) AS loss FROM losses")
def transfer_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out loss for each budget of target tokens; budget 0 is all of them."""
    return transfers(spark, sf_dir).select("lang", "split", "budget", "init", "n_tokens", F.round("loss", 6).alias("loss"))


@query(f"""WITH {_TRANSFERS},
points AS (SELECT lang, split, init, n_tokens, min(loss) AS loss FROM losses WHERE n_tokens > 0 GROUP BY ALL)
SELECT lang, split, init, round(regr_slope(ln(loss), ln(n_tokens)), 6) AS slope,
       round(regr_intercept(ln(loss), ln(n_tokens)), 6) AS intercept, count(*) AS n_points
FROM points GROUP BY lang, split, init""")
def scaling_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = corpus_lm.scaling_fit(transfers(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("slope", "intercept")]
    return fit.select("lang", "split", "init", "n_points", *rounded)
