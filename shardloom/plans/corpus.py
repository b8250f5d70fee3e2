"""Queries on splitting, ordering, tokenizing, packing and batching a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.arith import div
from shardloom.functions.text import digest
from shardloom.operators import batching, encode, ordering, packing, splits
from shardloom.operators.lookup import attach
from shardloom.operators.runlog import MODEL_SIZES
from shardloom.plans import tables
from shardloom.plans.registry import query
from shardloom.plans.sql import DOCS, SHARDS, TOKENS, VOCAB, packed, shuffled
from shardloom.plans.tables import CHUNK_DOCS, LENGTH
from shardloom.session import STORED_AS, new_path, stage
from shardloom.streaming import packing as streaming

SEED, STREAMS, EPOCHS = 7, 3, 2
BATCH = 8


@query(f"WITH {DOCS} SELECT doc_id, shard, split FROM docs")
def split_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "shard")
    return splits.split_by_shard(docs, tables.shards(spark, sf_dir))


# The file names that stand for a split.
_FILES = ("train.txt", "valid.txt", "test.txt", "web_text_zh_train.json", "web_text_zh_valid.json", "web_text_zh_testa.json")


@query(f"""
SELECT doc_id, path, CASE WHEN path LIKE '%train.%' THEN 'train' WHEN path LIKE '%valid.%' THEN 'val'
                          WHEN path LIKE '%/test.txt' OR path LIKE '%testa.json' THEN 'test' END AS split
FROM (SELECT doc_id, '/data/' || source || '/' || [{', '.join(f"'{f}'" for f in (*_FILES, 'notes.txt'))}][doc_id % 7 + 1] AS path
      FROM documents)""")
def split_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.array(*[F.lit(f) for f in (*_FILES, "notes.txt")])
    path = F.concat(F.lit("/data/"), "shard", F.lit("/"), F.get(files, (F.col("doc_id") % 7).cast("int")))
    docs = tables.documents(spark, sf_dir).select("doc_id", path.alias("path"))
    return docs.withColumn("split", splits.split_of_file("path"))


def _doc_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tokens(spark, sf_dir).select("shard", "doc_no", "doc_id", "n")


@query(f"WITH {TOKENS}, {shuffled(str(SEED))} SELECT shard, doc_id, chunk, doc_i FROM shuffled")
def shuffle_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled_docs = ordering.shuffle_docs(_doc_places(spark, sf_dir), F.lit(SEED), CHUNK_DOCS)
    return shuffled_docs.select("shard", "doc_id", "chunk", F.col("doc_i").cast("bigint").alias("doc_i"))


_ORDER = f"""
shard_order AS (
  SELECT stream, shard, row_number() OVER (PARTITION BY stream ORDER BY md5(concat_ws('|', stream, shard)), shard) - 1 AS shard_pos
  FROM shards CROSS JOIN (SELECT unnest(range({STREAMS})) AS stream) WHERE split = 'train')"""


def _train_order(spark: SparkSession, sf_dir: str, streams: int = STREAMS) -> DataFrame:
    train = tables.shards(spark, sf_dir).filter(F.col("split") == "train")
    return ordering.shard_order(train, streams)


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query(f"WITH {SHARDS}, {_ORDER} SELECT stream, shard, shard_pos FROM shard_order")
def shard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_order(spark, sf_dir).select("shard", *_long("stream", "shard_pos"))


@query(f"""WITH {TOKENS}, {shuffled("stream", streams=STREAMS)}, {_ORDER}
SELECT epoch, o.stream, o.shard_pos, d.chunk, d.doc_i, d.doc_id
FROM shuffled d JOIN shard_order o USING (stream, shard) CROSS JOIN (SELECT unnest(range({EPOCHS})) AS epoch)""")
def repeat_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents each stream reads, pass after pass."""
    docs = ordering.add_streams(_doc_places(spark, sf_dir), STREAMS)
    shuffled_docs = ordering.shuffle_docs(docs, F.col("stream"), CHUNK_DOCS, ("stream", "shard"))
    order = stage(_train_order(spark, sf_dir), "shard-order")
    visits = ordering.repeat_epochs(attach(shuffled_docs, ["stream", "shard"], order, F.col("doc_id")), EPOCHS).filter("shard_pos is not null")
    return visits.select("chunk", "doc_id", *_long("epoch", "stream", "shard_pos", "doc_i"))


def mixed_blocks(spark: SparkSession, sf_dir: str, split: str, streams: int = 1, epochs: int = 1) -> DataFrame:
    """Packed blocks of a split in interleaved order, with `n_blocks`, the length of the sequence."""
    docs = tables.tokens(spark, sf_dir).filter(F.col("split") == split)
    copies = ordering.add_streams(docs.select("shard", "doc_no", "doc_id", "n"), streams)
    shuffled_docs = ordering.shuffle_docs(copies, F.col("stream"), CHUNK_DOCS, ("stream", "shard"))
    scope = ["stream", "shard"]
    source = F.struct("shard", "doc_i", "doc_id")
    starts = packing.offsets(shuffled_docs, scope, ["shuffle_key"]).select("shard", "doc_no", "doc_id", "stream", "doc_i", "n", "start")
    placed = packing.place_copies(docs, starts, ["shard", "doc_no"])
    blocks = packing.pack_placed(placed, scope, LENGTH, provenance=source)
    names = tables.shards(spark, sf_dir).filter(F.col("split") == split)
    counts = packing.count_blocks(ordering.add_streams(docs.select("shard", "n"), streams), scope, LENGTH)
    offsets = stage(ordering.stream_offsets(counts, ordering.shard_order(names, streams)), "stream-offsets")
    mixed = ordering.interleave(blocks, offsets, streams, epochs)
    return mixed.withColumn("n_blocks", F.col("pass_blocks") * streams * epochs)


def _mixed_sql(split: str, streams: int = 1, epochs: int = 1) -> str:
    return f"""{TOKENS},
chosen AS (SELECT * FROM tokens WHERE split = '{split}'),
{shuffled("stream", "chosen", streams)}, {packed("stream, shard", "chunk, md5(concat_ws('|', stream, shard, doc_no))", "shuffled")},
ordered AS (
  SELECT stream, shard, row_number() OVER (PARTITION BY stream ORDER BY md5(concat_ws('|', stream, shard)), shard) - 1 AS shard_pos
  FROM shards CROSS JOIN (SELECT unnest(range({streams})) AS stream) WHERE split = '{split}'),
offsets AS (
  SELECT o.stream, o.shard, coalesce(sum(n) OVER (PARTITION BY o.stream ORDER BY shard_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shard_offset,
         sum(n) OVER (PARTITION BY o.stream) AS pass_blocks
  FROM (SELECT o.*, coalesce(n, 0) AS n FROM ordered o
        LEFT JOIN (SELECT stream, shard, count(*) AS n FROM blocks GROUP BY stream, shard) c USING (stream, shard)) o),
mixed AS (
  SELECT b.*, epoch, pass_blocks * {streams * epochs} AS n_blocks,
         ((epoch * pass_blocks + shard_offset + block_no) * {streams} + b.stream)::BIGINT AS mix_seq
  FROM blocks b JOIN offsets o USING (stream, shard) CROSS JOIN (SELECT unnest(range({epochs})) AS epoch))"""


@query(f"""WITH {_mixed_sql("train", STREAMS, EPOCHS)}
SELECT mix_seq, epoch, stream, shard, block_no, md5(array_to_string(tokens, ' ')) AS digest FROM mixed""")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixed_blocks(spark, sf_dir, "train", STREAMS, EPOCHS)
    return mixed.select("mix_seq", "shard", "block_no", *_long("epoch", "stream"), digest("tokens").alias("digest"))


@query(f"""WITH {VOCAB}, unknown AS (SELECT id FROM vocab WHERE token = '<unk>')
SELECT doc_id, count(*) AS n_ids, md5(string_agg(coalesce(v.id, unknown.id)::VARCHAR, ' ' ORDER BY i)) AS digest
FROM (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM tokens) t
CROSS JOIN unknown LEFT JOIN vocab v ON t.token = v.token GROUP BY doc_id""")
def encode_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.tokens(spark, sf_dir).select("doc_id", "tokens")
    ids = encode.encode(docs, ["doc_id"], tables.vocab(spark, sf_dir))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), digest("ids").alias("digest"))


@query(f"""WITH {TOKENS} SELECT doc_id, len(tokens) AS n, tokens[1] AS first, tokens[len(tokens)] AS last,
       md5(array_to_string(tokens, ' ')) AS digest FROM tokens""")
def wrap_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.get("tokens", F.lit(0)), F.element_at("tokens", -1)
    return tables.tokens(spark, sf_dir).select("doc_id", "n", first.alias("first"), last.alias("last"), digest("tokens").alias("digest"))


@query(f"""WITH {VOCAB}, {shuffled()}, {packed("stream, shard", "chunk, md5(concat_ws('|', 0, shard, doc_no))", "shuffled")}
SELECT b.shard, b.block_no, md5(coalesce(string_agg(t.token, ' ' ORDER BY t.i) FILTER (WHERE t.token <> '<eos>'
         AND t.token IN (SELECT token FROM vocab)), '')) AS digest
FROM blocks b JOIN (SELECT shard, block_no, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM blocks) t
  ON b.shard = t.shard AND b.block_no = t.block_no
GROUP BY b.shard, b.block_no""")
def decode_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are packed, then decoded; unknown words and end marks leave no text."""
    docs = ordering.shuffle_docs(tables.encoded(spark, sf_dir), F.lit(0), CHUNK_DOCS)
    blocks = packing.pack(docs, ["shard"], ["shuffle_key"], LENGTH, tokens="ids")
    text = encode.decode(blocks, ["shard", "block_no"], tables.vocab(spark, sf_dir))
    return text.select("shard", "block_no", F.md5("text").alias("digest"))


@query(f"""WITH {TOKENS},
words AS (SELECT lang, split, token, count(*) AS n FROM (SELECT lang, split, unnest(tokens) AS token FROM tokens)
          WHERE token <> '<eos>' GROUP BY ALL),
rated AS (
  SELECT w.lang, n, EXISTS (SELECT 1 FROM words k WHERE k.split = 'train' AND k.lang = 'en' AND k.token = w.token) AS base,
         EXISTS (SELECT 1 FROM words k WHERE k.split = 'train' AND k.lang = w.lang AND k.token = w.token) AS domain
  FROM words w WHERE split <> 'train'),
counted AS (
  SELECT lang, 'base' AS tokenizer, sum(n) AS n_tokens, coalesce(sum(n) FILTER (WHERE NOT base), 0) AS n_unknown FROM rated GROUP BY lang
  UNION ALL SELECT lang, 'domain', sum(n), coalesce(sum(n) FILTER (WHERE NOT domain), 0) FROM rated GROUP BY lang)
SELECT lang, tokenizer, n_tokens::BIGINT AS n_tokens, n_unknown::BIGINT AS n_unknown, round(n_unknown / n_tokens, 6) AS unknown_rate FROM counted""")
def vocab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words outside the train split under the English vocabulary and under the language's own."""
    exploded = tables.tokens(spark, sf_dir).select("lang", (F.col("split") == "train").alias("train"), F.explode("tokens").alias("token"))
    words = exploded.filter(F.col("token") != "<eos>").groupBy("lang", "train", "token").agg(F.count("*").alias("n"))
    words = stage(words, "words")
    own = words.filter("train").select("lang", "token", F.lit(True).alias("domain"))
    english = own.filter(F.col("lang") == "en").select("token", F.lit(True).alias("base"))
    held_out = words.filter(~F.col("train")).join(own, ["lang", "token"], "left").join(english, "token", "left")
    rated = held_out.select(
        "lang",
        "n",
        F.inline(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(t).isNull().alias("unknown")) for t in ("base", "domain")])),
    )
    counts = rated.groupBy("lang", "tokenizer").agg(
        F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("unknown"), F.col("n")).otherwise(0)).alias("n_unknown")
    )
    return counts.withColumn("unknown_rate", F.round(F.col("n_unknown") / F.col("n_tokens"), 6))


_PACKED = packed("stream, shard", "chunk, md5(concat_ws('|', 0, shard, doc_no))", "shuffled")


def _packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ordering.shuffle_docs(tables.tokens(spark, sf_dir), F.lit(0), CHUNK_DOCS)
    return packing.pack(docs, ["shard"], ["shuffle_key"], LENGTH)


@query(f"""WITH {TOKENS}, {shuffled()}, {_PACKED}
SELECT shard, block_no, len(tokens)::BIGINT AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM blocks""")
def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _packed_words(spark, sf_dir)
    return blocks.select("shard", "block_no", F.size("tokens").cast("bigint").alias("n_tokens"), digest("tokens").alias("digest"))


@query(f"WITH {TOKENS}, {shuffled()}, {_PACKED} SELECT shard, block_no, doc_i, doc_id FROM blocks")
def block_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ordering.shuffle_docs(_doc_places(spark, sf_dir), F.lit(0), CHUNK_DOCS)
    source = F.struct(F.col("doc_i").cast("bigint").alias("doc_i"), "doc_id")
    fired = packing.triggers(docs, ["shard"], ["shuffle_key"], LENGTH, source)
    return fired.select("shard", "block_no", "trigger.doc_i", "trigger.doc_id")


_IN_ORDER = f"""in_order AS (SELECT *, doc_no AS doc_i FROM tokens), {packed("shard", "doc_no", "in_order")}"""


@query(f"""WITH {TOKENS}, {_IN_ORDER}
SELECT shard, block_no, (block_no + 1) * {LENGTH} AS tokens_seen, md5(array_to_string(tokens, ' ')) AS digest
FROM blocks""")
def token_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of documents in file order, with the tokens seen so far in the shard."""
    docs = ordering.place_in_chunks(tables.tokens(spark, sf_dir))
    blocks = packing.pack(docs, ["shard"], ["doc_no"], LENGTH)
    counted = packing.limit_tokens(blocks, LENGTH)
    return counted.select("shard", "block_no", "tokens_seen", digest("tokens").alias("digest"))


@query(f"""WITH {TOKENS}, {_IN_ORDER}
SELECT shard, block_no, doc_no, md5(array_to_string(tokens, ' ')) AS digest FROM blocks""")
def pack_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in three waves; the stream is stopped and resumed in between."""
    docs = tables.tokens(spark, sf_dir).select("shard", "doc_no", "tokens", "n")
    docs = docs.withColumn("wave", F.least(div("doc_no", 5), F.lit(2)))
    arrivals, out, progress = (new_path(spark, label) for label in ("arrivals", "packed", "progress"))
    for wave in range(3):
        docs.filter(F.col("wave") == wave).drop("wave").write.mode("append").parquet(arrivals, compression=STORED_AS)
        stream = spark.readStream.schema(docs.drop("wave").schema).parquet(arrivals)
        streaming.pack_stream(stream, out, progress, LENGTH, ["shard"], CHUNK_DOCS).awaitTermination()
    blocks = streaming.read_packed(spark, out)
    return blocks.select("shard", "block_no", F.col("trigger").alias("doc_no"), digest("tokens").alias("digest"))


@query(f"""WITH {_mixed_sql("train")}
SELECT mix_seq // {BATCH} AS batch_id, mix_seq % {BATCH} AS slot, shard, block_no FROM mixed
WHERE mix_seq // {BATCH} < n_blocks // {BATCH}""")
def batch_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = batching.batch_blocks(mixed_blocks(spark, sf_dir, "train"), "mix_seq", "n_blocks", BATCH)
    return batched.select("batch_id", "slot", "shard", "block_no")


@query(f"""WITH {_mixed_sql("train")}
SELECT mix_seq // {BATCH} AS batch_id, count(*) AS n_rows,
       md5(string_agg(array_to_string(tokens, ' '), '|' ORDER BY mix_seq)) AS matrix,
       string_agg(shard || ':' || doc_i, ' ' ORDER BY mix_seq) AS meta
FROM mixed WHERE mix_seq // {BATCH} < n_blocks // {BATCH} GROUP BY mix_seq // {BATCH}""")
def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = batching.batch_blocks(mixed_blocks(spark, sf_dir, "train"), "mix_seq", "n_blocks", BATCH)
    rows = batching.collate(batched, [])
    lines = F.transform("matrix", lambda r: F.array_join(r, " "))
    sources = F.transform("meta", lambda m: F.concat_ws(":", m["shard"], m["doc_i"].cast("string")))
    return rows.select(
        "batch_id",
        F.size("matrix").cast("bigint").alias("n_rows"),
        F.md5(F.array_join(lines, "|")).alias("matrix"),
        F.array_join(sources, " ").alias("meta"),
    )


def _sequence(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Sequence numbers of a split's blocks from token counts alone: one stream numbers its blocks without gaps."""
    docs = tables.tokens(spark, sf_dir).filter(F.col("split") == split).select("shard", "n")
    counts = packing.count_blocks(docs, ["shard"], LENGTH)
    n_blocks = counts.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)).cast("bigint")).first()[0]
    return spark.range(n_blocks).select(F.col("id").alias("mix_seq"), F.lit(n_blocks).cast("bigint").alias("n_blocks"))


def _counts_sql(*splits_: str) -> str:
    """One row per split: how many blocks its shards give."""
    names = ", ".join(f"'{s}'" for s in splits_)
    return f"""{TOKENS}, per_shard AS (
  SELECT split, shard, (sum(len(tokens)) - 1) // {LENGTH} AS n_blocks FROM tokens WHERE split IN ({names}) GROUP BY split, shard),
totals AS (SELECT split, sum(n_blocks)::BIGINT AS n_blocks FROM per_shard GROUP BY split),
seq AS (SELECT n_blocks, unnest(range(n_blocks)) AS mix_seq FROM totals WHERE split = 'train')"""


GLOBAL_BATCH = 32
_SIZES = [s[0] for s in MODEL_SIZES]


@query(f"""WITH {_counts_sql("train")},
sizes AS (SELECT unnest([{', '.join(f"'{s}'" for s in _SIZES)}]) AS size),
placed AS (
  SELECT size, mini, {GLOBAL_BATCH} // mini AS accumulate, mix_seq // mini AS batch_id
  FROM (SELECT size, CASE WHEN size IN ('x2small', 'small') THEN 2 ELSE 8 END AS mini FROM sizes) CROSS JOIN seq
  WHERE mix_seq // mini < n_blocks // mini)
SELECT size, mini::BIGINT AS mini, accumulate::BIGINT AS accumulate, batch_id // accumulate AS step, count(DISTINCT batch_id) AS n_batches, count(*) AS n_blocks
FROM placed GROUP BY ALL""")
def assign_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimizer steps per model size: how many micro-batches and blocks each step takes."""
    sizes = F.explode(F.array(*[F.lit(s) for s in _SIZES])).alias("size")
    seq = _sequence(spark, sf_dir, "train").select("*", sizes)
    seq = seq.withColumn("mini", batching.mini_batch_size(F.col("size")).cast("bigint"))
    seq = seq.withColumn("accumulate", batching.accumulate_batches(F.lit(GLOBAL_BATCH), F.col("mini")))
    batched = batching.batch_blocks(seq, "mix_seq", "n_blocks", F.col("mini"))
    steps = batched.withColumn("step", batching.optimizer_step(F.col("batch_id"), F.col("accumulate")))
    return steps.groupBy("size", "mini", "accumulate", "step").agg(
        F.count_if(F.col("slot") == 0).alias("n_batches"), F.count("*").alias("n_blocks")
    )


LIMITS = (-1, 1, 4, 16)


@query(f"""WITH {_counts_sql("train")},
placed AS (SELECT lim, mix_seq // {BATCH} AS batch_id FROM seq CROSS JOIN (SELECT unnest([{', '.join(map(str, LIMITS))}]) AS lim)
           WHERE mix_seq // {BATCH} < n_blocks // {BATCH})
SELECT lim::BIGINT AS batch_limit, count(DISTINCT batch_id) AS n_batches, count(*) * {LENGTH} AS n_tokens,
       (lim * {GLOBAL_BATCH} * {LENGTH})::BIGINT AS dataset_size
FROM placed WHERE lim <= 0 OR batch_id < lim * {GLOBAL_BATCH // BATCH} GROUP BY lim""")
def budget_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of an epoch under several batch limits."""
    accumulate = batching.accumulate_batches(F.lit(GLOBAL_BATCH), F.lit(BATCH))
    batched = batching.batch_blocks(_sequence(spark, sf_dir, "train"), "mix_seq", "n_blocks", BATCH)
    limits = F.explode(F.array(*[F.lit(x).cast("bigint") for x in LIMITS])).alias("batch_limit")
    kept = batched.select("batch_id", "slot", limits).filter(
        batching.within_budget(F.col("batch_id"), F.col("batch_limit"), accumulate)
    )
    return kept.groupBy("batch_limit").agg(
        F.count_if(F.col("slot") == 0).alias("n_batches"), (F.count("*") * LENGTH).alias("n_tokens")
    ).withColumn("dataset_size", batching.budget_tokens(F.col("batch_limit"), F.lit(GLOBAL_BATCH), F.lit(LENGTH)))


INTERVALS, MAX_EVAL_STEPS, EVAL_BATCH = (0, 1, 3), 4, 5


@query(f"""WITH {_counts_sql("train", "val")},
modes AS (SELECT * FROM (VALUES ('single', {GLOBAL_BATCH // BATCH}, 1), ('multi', 1, {GLOBAL_BATCH // BATCH})) m(mode, times, val_times)
          CROSS JOIN (SELECT unnest([{', '.join(map(str, INTERVALS))}]) AS eval_interval)),
batches AS (SELECT DISTINCT mix_seq // {BATCH} AS batch_id, n_blocks // {BATCH} AS n_batches FROM seq WHERE mix_seq // {BATCH} < n_blocks // {BATCH})
SELECT mode, eval_interval::BIGINT AS eval_interval, batch_id,
       least({MAX_EVAL_STEPS} * val_times, (SELECT n_blocks // {EVAL_BATCH} FROM totals WHERE split = 'val'))::BIGINT AS val_batches
FROM batches CROSS JOIN modes
WHERE CASE WHEN eval_interval > 0 THEN (batch_id + 1) % (eval_interval * times) = 0 ELSE batch_id + 1 = n_batches END""")
def eval_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After which micro-batches an evaluation runs, and over how many validation batches."""
    accumulate = batching.accumulate_batches(F.lit(GLOBAL_BATCH), F.lit(BATCH))
    batched = batching.batch_blocks(_sequence(spark, sf_dir, "train"), "mix_seq", "n_blocks", BATCH).filter("slot = 0")
    val = packing.count_blocks(tables.tokens(spark, sf_dir).filter(F.col("split") == "val"), ["shard"], LENGTH)
    available = val.agg(div(F.coalesce(F.sum("n_blocks"), F.lit(0)), EVAL_BATCH)).first()[0]
    plans = F.array(
        *[
            F.struct(
                F.lit(mode).alias("mode"),
                F.lit(every).cast("bigint").alias("eval_interval"),
                batching.evaluation_interval(F.lit(every), accumulate, mode).alias("interval"),
                batching.validation_limit(F.lit(MAX_EVAL_STEPS), accumulate, mode).alias("val_limit"),
            )
            for mode in ("single", "multi")
            for every in INTERVALS
        ]
    )
    planned = batched.select("batch_id", div("n_blocks", BATCH).alias("n_batches"), F.inline(plans))
    due = planned.filter(batching.evaluates_after(F.col("batch_id"), F.col("n_batches"), F.col("interval")))
    return due.select("mode", "eval_interval", "batch_id", F.least("val_limit", F.lit(available)).alias("val_batches"))


@query(f"""WITH {TOKENS}, {shuffled()}, {_PACKED},
made AS (SELECT shard, count(*) AS n_blocks FROM blocks GROUP BY shard)
SELECT split, shard, count(*) AS n_docs, sum(len(tokens))::BIGINT AS n_tokens,
       coalesce(any_value(n_blocks), 0) AS n_blocks, coalesce(any_value(n_blocks), 0) // {BATCH} AS n_batches
FROM tokens LEFT JOIN made USING (shard) GROUP BY split, shard""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From documents to full batches, one row per shard."""
    docs = tables.tokens(spark, sf_dir)
    sizes = docs.groupBy("split", "shard").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
    made = packing.count_blocks(docs.select("shard", "n"), ["shard"], LENGTH).select("shard", "n_blocks")  # from lengths: no token is read
    joined = sizes.join(made, "shard", "left").fillna(0, ["n_blocks"])
    return joined.select("split", "shard", "n_docs", "n_tokens", "n_blocks", div("n_blocks", BATCH).alias("n_batches"))
