"""The dealt operators over the given tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import best_fit, byte_bpe, chat, filter_audit, jaccard_join, licenses, line_dedup, merkle, mixing, quality, secrets, token_files, top_k
from shardloom.llm.common import table
from shardloom.plans.registry import query

_CHATS = """
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(text, '([<\\[])(\\\\*(?:/?s>|sep>|/?INST\\]))', '\\1\\\\\\2', 'g')) AS text_n,
    length(regexp_replace(role, '([<\\[])(\\\\*(?:/?s>|sep>|/?INST\\]))', '\\1\\\\\\2', 'g')) AS role_n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role
      OR row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1 AS opens
  FROM raw
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_n + CASE WHEN opens THEN 3 + role_n + (CASE role WHEN 'assistant' THEN 7 ELSE 6 END) + 4 ELSE 5 END) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (opens) AS BIGINT) AS n_blocks
FROM escaped GROUP BY conv_id
"""


@query(_CHATS)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-7).cast("bigint"), F.lit(i).cast("bigint"), F.lit(r), F.lit(said)) for i, r in enumerate(("user", "assistant"))]))
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(turns.union(extra))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CANONICAL = f"regexp_replace(regexp_replace({_FOLDED}, '{licenses.COPYRIGHT_LINE}', '', 'g'), '{licenses.MARKS}', ' ', 'g')"
for _other, _usual in licenses.SPELLINGS:
    _CANONICAL = f"replace({_CANONICAL}, '{_other}', '{_usual}')"
_DIGEST = "CASE WHEN trim(regexp_replace(t, '[ \\n]+', ' ', 'g')) <> '' THEN sha256(trim(regexp_replace(t, '[ \\n]+', ' ', 'g'))) END"
_KNOWN = ", ".join(
    "('{}', '{}')".format(name, text.replace("'", "''"))
    for name, text in [*licenses.TEXTS.items(), *((n, line) for n, lines in licenses.NOTICES.items() for line in lines)]
)
_LICENSES = f"""
WITH known AS (
  SELECT d, min(license_id) AS license_id FROM (SELECT license_id, {_DIGEST} AS d FROM (
    SELECT license_id, {_CANONICAL} AS t FROM (VALUES {_KNOWN}) k(license_id, text))) WHERE d IS NOT NULL GROUP BY d
), texts AS (SELECT doc_id, row_number() OVER () AS r, {_CANONICAL} AS t FROM documents
), whole AS (SELECT doc_id, r, {_DIGEST} AS d FROM texts
), lines AS (SELECT r, {_DIGEST} AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS t FROM texts)
), notices AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names FROM lines JOIN known USING (d) GROUP BY r
)
SELECT doc_id, w.d AS text_digest, k.license_id, coalesce(n.n, 0) AS n_notices, coalesce(n.names, '') AS notices
FROM whole w LEFT JOIN known k ON k.d = w.d LEFT JOIN notices n USING (r)
"""


@query(_LICENSES)
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM sizes GROUP BY source
), caps AS (
  SELECT *, 3 * source_size AS most, row_number() OVER (ORDER BY 3 * source_size / weight, source IS NULL, source) AS i,
    (SELECT sum(source_size) FROM ranked) AS whole FROM ranked
), cuts AS (
  SELECT *, CAST(whole - (sum(most) OVER w - most) AS DOUBLE) AS rest, CAST((SELECT sum(weight) FROM ranked) - (sum(weight) OVER w - weight) AS DOUBLE) AS over_weight
  FROM caps WINDOW w AS (ORDER BY i)
), level AS (SELECT rest, over_weight FROM cuts WHERE most * over_weight > rest * weight ORDER BY i LIMIT 1
), aims AS (
  SELECT source, source_size, CASE WHEN most * over_weight <= rest * weight THEN CAST(most AS DOUBLE) ELSE rest * weight / over_weight END AS target
  FROM (SELECT source, source_size, most, weight FROM caps) LEFT JOIN level ON true
), budgets AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM aims
), runs AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.passes, b.budget - b.passes * b.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM runs
"""


@query(_MIXING)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored_digest(table(spark, sf_dir, "documents"))


@query()
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.search(vectors, vectors.filter("vec_id % 50 = 0"))


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query()
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


@query()
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
_AUDIT = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), split AS (SELECT *, {_WORDS} AS words, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY text) AS first FROM texts
), masks AS (
  SELECT doc_id, part, [len(words) < 200, 100 * list_unique(words) < 50 * len(words), 100 * capitals > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM split
), marks AS (SELECT doc_id, bool_or(quality = 1) AS quality, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, fails, count(*) AS docs, count(*) FILTER (quality) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(range(1, 6)) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT o, list_aggregate(list_transform(o, lambda f: 'ABCDE'[f]), 'string_agg', '') AS filter_order, unnest(range(1, 6)) AS step FROM orders
), folded AS (
  SELECT *, fails[o[step]] AS fail, list_bool_or(list_transform(o[1:step - 1], lambda f: fails[f])) AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AND fails[o[step]] AS alone FROM cells, steps
), summed AS (
  SELECT part, filter_order, step, o[step] AS f, sum(docs) FILTER (NOT fail AND NOT coalesce(gone, false)) AS kept,
    sum(docs) FILTER (fail AND NOT coalesce(gone, false)) AS removed, sum(docs) FILTER (fail AND gone) AS redundant, sum(docs) FILTER (alone) AS unique_fails,
    sum(good) FILTER (fail AND NOT coalesce(gone, false)) AS good_lost, sum(toxic) FILTER (fail AND NOT coalesce(gone, false)) AS toxic_lost
  FROM folded GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in filter_audit.COUNTS)},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM summed
"""


@query(_AUDIT)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_FIELD = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
# Nodes of all levels of the trees over some leaves, and what stands left and right of a leaf's ancestor at each level.
_TREE = lambda name, leaves: f"""{name} AS (
  SELECT 0 AS level, part, pos, h FROM {leaves} UNION ALL
  SELECT level + 1, part, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM {name})
  WHERE n > 1 GROUP BY level, part, pos // 16
), {name}_tops AS (SELECT part, max(level) AS top, arg_max(h, level) AS h FROM {name} GROUP BY part)"""  # noqa: E731
_SIDES = lambda key, leaves, name, first: f"""
  SELECT l.{key}, {first} + l.level AS step, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < l.up), '') AS a,
    coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > l.up), '') AS b
  FROM (SELECT r.{key}, r.part, level, r.pos // CAST(power(16, level) AS BIGINT) AS up FROM {leaves} r
        JOIN (SELECT part, unnest(range(top)) AS level FROM {name}_tops) USING (part)) l
  JOIN {name} n ON n.part = l.part AND n.level = l.level AND n.pos // 16 = l.up // 16 GROUP BY l.{key}, l.level"""  # noqa: E731
_MERKLE = f"""
WITH RECURSIVE crcs AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), hashed AS (
  SELECT row_number() OVER () AS leaf_no, doc_id, source, {_LEAF("text")} AS h, CASE WHEN crc % 5 = 0
    THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered FROM documents LEFT JOIN crcs USING (doc_id)
), leaves AS (
  SELECT *, coalesce('=' || source, '') AS part, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM hashed
), {_TREE("nodes", "leaves")}, subroots AS (
  SELECT part AS name, '' AS part, row_number() OVER (ORDER BY encode(part)) - 1 AS pos, h FROM nodes_tops
), {_TREE("over", "subroots")}, above AS ({_SIDES("name", "subroots", "over", 100)}
), sides AS ({_SIDES("leaf_no", "leaves", "nodes", 0)}
  UNION ALL SELECT leaf_no, step, a, b FROM above JOIN leaves ON leaves.part = name
), ways AS (SELECT leaf_no, list(a ORDER BY step) AS a, list(b ORDER BY step) AS b, sha256(string_agg(a || b, '' ORDER BY step)) AS proof FROM sides GROUP BY leaf_no
), folds AS (
  SELECT leaf_no, 1 AS i, coalesce(altered, h) AS node, a, b FROM leaves LEFT JOIN ways USING (leaf_no)
  UNION ALL SELECT leaf_no, i + 1, sha256(a[i] || node || b[i]), a, b FROM folds WHERE i <= len(a)
)
SELECT doc_id, leaves.h AS leaf, t.h AS subroot, o.h AS root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = o.h AS verified
FROM leaves JOIN nodes_tops t USING (part) CROSS JOIN over_tops o LEFT JOIN ways USING (leaf_no)
JOIN (SELECT leaf_no, arg_max(node, i) AS node FROM folds GROUP BY leaf_no) USING (leaf_no)
"""


@query(_MERKLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query()
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(table(spark, sf_dir, "documents"))
