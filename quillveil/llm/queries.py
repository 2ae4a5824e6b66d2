"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import ann, chat, exact_dedup, langid, licenses, minhash, mixing, packing, secrets, sharding


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op2_balanced_posting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op4_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_automaton_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_entropy_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_bloom_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


#: Conversation -1, whose texts are made of control strings.
PROBE = "</s>[INST] ok [/INST]"


def op8_typed_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chat(rows.unionByName(probe)))


def op9_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bagminhash_near_dedup,
        op2_balanced_posting_search,
        op3_differencing_packing,
        op4_block_mixing,
        op5_automaton_license_scan,
        op6_entropy_secret_scan,
        op7_bloom_language_id,
        op8_typed_chat_format,
        op9_sampled_splitter_shards,
        op10_content_hash_dedup,
    )
}

def _escapes(col: str) -> str:
    """Characters that escaping adds to a text."""
    return " + ".join([f"(length({col}) - length(replace({col}, '{c}', ''))) // {len(c)} * 2" for c in chat.CONTROL] + [f"length({col}) - length(replace({col}, '{chat.MARK}', ''))"])


_KIND = " ".join(f"WHEN regexp_matches(ref, '{p}') THEN '{k}'" for k, p in chat.SUFFIXES.items())

def _secret_spans(kind: int, pattern: str, least: int = 0, group: int = 0) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT doc_id, {kind} AS k, e - length(m) AS s, e, v FROM (
  SELECT doc_id, m, v, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gs FROM d WHERE regexp_matches(t, {p}))
  )
) WHERE length(v) >= {least}"""


def _hot(cls: secrets.CharClass, value: str) -> str:
    """Whether any window's sum of terms is small enough."""
    counts = f"list_transform(list_distinct(string_split(x, '')), lambda c: [{', '.join(map(str, secrets.TERMS))}][length(x) - length(replace(x, c, '')) + 1])"
    windows = f"list_transform(range(1, greatest(length({value}) - {cls.window - 2}, 1)), lambda i: substr({value}, i, {cls.window}))"
    return f"len(list_filter({windows}, lambda x: list_sum({counts}) <= {secrets.limit(cls)})) > 0"


_HEX, _BASE64 = secrets.CLASSES

ORACLES = {
    "op6_entropy_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_secret_spans(0, secrets.ASSIGN, 12, 2)} UNION ALL {_secret_spans(1, secrets.ACCESS, 18)} UNION ALL {_secret_spans(2, secrets.HEX)}),
c AS (SELECT *, list_filter(string_split(v, '/'), lambda x: x <> '') AS names FROM ({_secret_spans(3, secrets.CANDIDATE)})),
added AS (
  SELECT doc_id, k, s, e FROM c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)
    AND NOT regexp_matches(v, '{secrets.UUID}') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND regexp_replace(v, '{secrets.STAND_IN}', '', 'g') <> ''
    AND NOT ((v[1] = '/' OR contains(v, '//')) AND NOT contains(v, '///') AND len(names) - CASE WHEN v[1] = '/' THEN 0 ELSE 1 END >= 2
      AND len(list_filter(names, lambda n: len(list_filter(string_split_regex(n, '[_-]'), lambda x: NOT regexp_matches(x, '{secrets.WORD}'))) > 0)) = 0)
    AND CASE WHEN regexp_matches(v, '{_HEX.pattern}') THEN {_hot(_HEX, "lower(v)")} ELSE {_hot(_BASE64, "v")} END
),
listed AS (SELECT doc_id, k, s, e, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e AS told FROM (SELECT doc_id, k, s, e FROM base UNION ALL SELECT * FROM added)),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(told, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(told, ',' ORDER BY s, k, e) AS spans FROM listed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "op1_bagminhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, s, count(*) AS c FROM s GROUP BY doc_id, s),
n AS (SELECT doc_id, CAST(sum(c) AS DOUBLE) AS n FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, CAST(sum(least(a.c, b.c)) AS DOUBLE) AS met FROM c a JOIN c b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE met / (x.n + y.n - met) >= 0.8),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS class_id FROM documents d LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM k
""",
    "op8_typed_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), m AS (SELECT row_number() OVER () AS r, *, regexp_extract_all(text, '{chat.MEDIA}', 1) AS refs, regexp_replace(text, '{chat.MEDIA}', chr(0), 'g') AS bare FROM t
), k AS (SELECT r, CASE {_KIND} ELSE 'image' END AS kind FROM (SELECT r, unnest(refs) AS ref FROM m)
), a AS (SELECT r, sum(length(kind) + 4 - 1) AS placed, count(*) AS n, sum(CASE kind WHEN 'image' THEN 256 WHEN 'audio' THEN 0 ELSE 256 END) AS tokens FROM k GROUP BY r
), u AS (
  SELECT m.*, coalesce(n, 0) AS n, coalesce(tokens, 0) AS tokens, length('<|im_start|>') + length(role) + ({_escapes("role")}) + length(role) - length(replace(role, chr(10), '')) + 1
    + length(bare) + coalesce(placed, 0) + ({_escapes("bare")}) + length('<|im_end|>') + 1 AS chars
  FROM m LEFT JOIN a ON m.r = a.r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(sum(n) AS BIGINT) AS n_attachments, CAST(sum(tokens) AS BIGINT) AS expanded_tokens
FROM u GROUP BY conv_id
""",
    "op10_content_hash_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AND row_number() OVER (PARTITION BY norm, doc_id) = 1 AS kept,
  sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
""",
}
