"""SQL for the derived tables, shared by the queries' SQL forms."""

from __future__ import annotations

from shardloom.plans.tables import CHUNK_DOCS, LENGTH, TRAIN_SHARDS, VAL_BATCHES, VAL_SHARDS

# The word pattern for engines whose \w and \s know ASCII only, by Unicode categories.
_WORD = (
    r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}"
    r"\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
)
WORD_PATTERN = rf"[{_WORD}]+|[^{_WORD}\t-\r\x{{85}}\p{{Z}}]+"

SHARDS = f"""
shards AS (
  SELECT shard, shard_rank,
    CASE WHEN shard_rank < {TRAIN_SHARDS} THEN 'train'
         WHEN shard_rank < {TRAIN_SHARDS + VAL_SHARDS} THEN 'val' ELSE 'test' END AS split
  FROM (SELECT source AS shard, row_number() OVER (ORDER BY source) - 1 AS shard_rank
        FROM (SELECT DISTINCT source FROM documents)))"""

DOCS = f"""{SHARDS},
docs AS (
  SELECT d.source AS shard, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS doc_no,
         d.doc_id, d.lang, d.text, s.split
  FROM documents d JOIN shards s ON d.source = s.shard)"""

TOKENS = f"""{DOCS},
tokens AS (
  SELECT shard, doc_no, doc_id, lang, split,
         list_concat(['<eos>'], list_concat(regexp_extract_all(text, '{WORD_PATTERN}'), ['<eos>'])) AS tokens
  FROM docs)"""

VOCAB = f"""{TOKENS},
words AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id
  FROM (SELECT unnest(tokens) AS token FROM tokens WHERE split = 'train')
  WHERE token <> '<eos>' GROUP BY token),
vocab AS (
  SELECT token, id FROM words
  UNION ALL SELECT '<unk>', (SELECT count(*) FROM words)
  UNION ALL SELECT '<bos>', (SELECT count(*) FROM words) + 1
  UNION ALL SELECT '<eos>', (SELECT count(*) FROM words) + 2)"""

RUN_LOG = f"""
ranked AS (
  SELECT user_id AS run_id, value / 100 AS loss,
         CASE WHEN event_type IN ('view', 'click') THEN 'train'
              WHEN event_type IN ('purchase', 'error') THEN 'validation' ELSE 'test' END AS split,
         ts, event_id
  FROM events),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, split ORDER BY ts, event_id) - 1 AS r FROM ranked),
run_log AS (
  SELECT run_id, split, CASE WHEN split = 'validation' THEN r // {VAL_BATCHES} ELSE r END AS global_step,
         CASE WHEN split = 'validation' THEN r % {VAL_BATCHES} ELSE 0 END AS batch_idx, loss
  FROM numbered)"""


def run_params(sizes: list[str]) -> str:
    names = ", ".join(f"'{s}'" for s in sizes)
    return f"""{RUN_LOG},
run_params AS (
  SELECT run_id, [{names}][(run_id % {len(sizes)} + 1)::INT] AS size, 8 * (run_id % 3 + 1) AS batch_size,
         {LENGTH} AS n_ctx, CASE WHEN run_id % 2 = 0 THEN -1.0::DOUBLE ELSE 0.001::DOUBLE * (run_id % 5 + 1) END AS lr,
         -1 AS d_embd, 3 AS warmup, 20 AS max_step,
         run_id % 4 - 1 AS limit_train_batches, run_id % 3 AS eval_interval
  FROM (SELECT DISTINCT run_id FROM run_log))"""


def shuffled(seed: str = "0", source: str = "tokens", streams: int = 1) -> str:
    """Documents in chunk order with doc_i, one copy per stream seeded by its number."""
    return f"""
copies AS (SELECT t.*, s.stream, doc_no // {CHUNK_DOCS} AS chunk
           FROM {source} t CROSS JOIN (SELECT unnest(range({streams})) AS stream) s),
shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY stream, shard, chunk
                               ORDER BY md5(concat_ws('|', {seed}, shard, doc_no))) - 1 AS doc_i
  FROM copies)"""


def packed(scope: str, order: str, source: str, items: str = "tokens", length: int = LENGTH) -> str:
    """Blocks by walking the tokens one by one; `fires` holds the doc_id, doc_i and doc_no that emitted the block."""
    return f"""
walk AS (
  SELECT {scope}, doc_id, doc_no, doc_i, tok, row_number() OVER (PARTITION BY {scope} ORDER BY {order}, i) - 1 AS pos
  FROM (SELECT *, unnest({items}) AS tok, unnest(range(len({items}))) AS i FROM {source})),
fires AS (
  SELECT {scope}, pos // {length} - 1 AS block_no, doc_id, doc_no, doc_i FROM walk WHERE pos % {length} = 0 AND pos > 0),
blocks AS (
  SELECT {', '.join('w.' + c.strip() for c in scope.split(','))}, w.block_no, w.tokens, f.doc_id, f.doc_no, f.doc_i
  FROM (SELECT {scope}, pos // {length} AS block_no, list(tok ORDER BY pos) AS tokens
        FROM walk GROUP BY {scope}, pos // {length}) w
  JOIN fires f USING ({scope}, block_no))"""
