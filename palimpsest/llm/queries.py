"""The registered queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc, chat, langid, maxscore, mixing, packing, quality, secrets, simhash, tokens
from .shared import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeated_passages(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.vocabulary_file("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary_file("word_bpe_49k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_substring_dedup,
        op3_quality_rules,
        op4_secret_scan,
        op5_token_counts,
        op6_language_id,
        op7_exact_top_k,
        op8_source_mix,
        op9_best_fit_pack,
        op10_chat_format,
    )
}

_WORDS = r"""
WITH w AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT *, len(words) AS n_words,
         list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) AS grams,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM w),
twice AS (
  SELECT id, list(pos) AS pos FROM (
    SELECT id, pos, count(*) OVER (PARTITION BY id, gram) AS n
    FROM (SELECT id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS pos FROM g))
  WHERE n > 1 GROUP BY id),
f AS (
  SELECT g.doc_id, lang, source, n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(len(list_distinct(flatten(list_transform(twice.pos, lambda p: range(p, p + 5))))), 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g')) AS n_marks, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(range(1, len(words) + 1), lambda i: list_contains(words[greatest(1, i - 8):i - 1], words[i]))) AS n_echoes
  FROM g LEFT JOIN twice USING (id)),
m AS (
  SELECT *, least(1000 * n_marks // greatest(word_chars, 1), 10000) AS mark, least(1000 * n_upper // greatest(word_chars, 1), 10000) AS upper_,
         1000 * n_echoes // greatest(n_words, 1) AS echo, least(100 * word_chars // greatest(n_words, 1), 10000) AS length_,
         least(CAST(floor(sqrt(n_words)) AS BIGINT), 10000) AS root FROM f),
long AS (
  SELECT lang, source, unnest(['mark', 'upper', 'echo', 'length', 'root']) AS metric, unnest([mark, upper_, echo, length_, root]) AS bin FROM m),
every AS (
  SELECT *, q2 - q1 + 1 + q2 // 16 AS above, q3 - q2 + 1 + q2 // 16 AS below FROM (
    SELECT metric, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.5) AS q2, quantile_disc(bin, 0.75) AS q3 FROM long GROUP BY ALL)),
wide AS (
  SELECT w.lang, w.metric, (w.n * w.q1 + 20 * e.q1) // (w.n + 20) AS q1, (w.n * w.q2 + 20 * e.q2) // (w.n + 20) AS q2, (w.n * w.q3 + 20 * e.q3) // (w.n + 20) AS q3, (w.n * w.above + 20 * e.above) // (w.n + 20) AS above, (w.n * w.below + 20 * e.below) // (w.n + 20) AS below
  FROM (SELECT *, q2 - q1 + 1 + q2 // 16 AS above, q3 - q2 + 1 + q2 // 16 AS below FROM (
    SELECT lang, metric, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.5) AS q2, quantile_disc(bin, 0.75) AS q3 FROM long GROUP BY ALL)) AS w
  JOIN every AS e ON w.metric = e.metric),
own AS (
  SELECT o.lang, o.source, o.metric, (o.n * o.q1 + 20 * w.q1) // (o.n + 20) AS q1, (o.n * o.q2 + 20 * w.q2) // (o.n + 20) AS q2, (o.n * o.q3 + 20 * w.q3) // (o.n + 20) AS q3, (o.n * o.above + 20 * w.above) // (o.n + 20) AS above, (o.n * o.below + 20 * w.below) // (o.n + 20) AS below, w.q1 AS w1, w.q3 AS w3, w.above AS wabove, w.below AS wbelow
  FROM (SELECT *, q2 - q1 + 1 + q2 // 16 AS above, q3 - q2 + 1 + q2 // 16 AS below FROM (
    SELECT lang, source, metric, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.5) AS q2, quantile_disc(bin, 0.75) AS q3 FROM long GROUP BY ALL)) AS o
  JOIN wide AS w ON o.lang IS NOT DISTINCT FROM w.lang AND o.metric = w.metric),
fence AS (
  SELECT lang, source, metric, greatest(q2, w1 - wbelow) AS low, least(below, 2 * wbelow) AS below, least(q2, w3 + wabove) AS high, least(above, 2 * wabove) AS above FROM own),
bound AS (
  SELECT lang, source, max(low) FILTER (metric = 'root') AS root_low, max(low) FILTER (metric = 'length') AS length_low, max(below) FILTER (metric = 'length') AS length_below,
         max(high) FILTER (metric = 'length') AS length_high, max(above) FILTER (metric = 'length') AS length_above,
         max(high) FILTER (metric = 'mark') AS mark_high, max(above) FILTER (metric = 'mark') AS mark_above, max(high) FILTER (metric = 'upper') AS upper_high,
         max(above) FILTER (metric = 'upper') AS upper_above, max(high) FILTER (metric = 'echo') AS echo_high, max(above) FILTER (metric = 'echo') AS echo_above FROM fence GROUP BY ALL),
beyond AS (
  SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         [mark - mark_high, upper_ - upper_high, echo - echo_high, length_ - length_high, length_low - length_] AS away,
         [mark_above + 200 // size, upper_above + 200 // size, echo_above + 1000 // size, length_above + 100 // size, length_below + 100 // size] AS spread, greatest(n_words, size) AS room
  FROM m JOIN (SELECT *, greatest(1, root_low * root_low) AS size FROM bound) AS bound ON m.lang IS NOT DISTINCT FROM bound.lang AND m.source IS NOT DISTINCT FROM bound.source),
judged AS (
  SELECT *, len(list_filter(list_zip(away, spread), lambda z: z[1] > 0 AND z[1] * z[1] * n_words > 64 * z[2] * z[2] * room)) = 0 AS fits FROM beyond)
"""

_SPANS = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT id, text, 'assign' AS kind, 0 AS rank, 8 AS least,
         regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS hit,
         regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS val,
         string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gap FROM t
  UNION ALL SELECT id, text, 'access', 1, 16, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT id, text, 'hex', 2, 32, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM t
  UNION ALL SELECT id, text, 'pem', 3, 1, regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM t
  UNION ALL SELECT id, text, 'jwt', 4, 1, regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}'), regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}'), string_split_regex(text, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}') FROM t
  UNION ALL SELECT id, text, 'github', 5, 1, regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}'), regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}'), string_split_regex(text, 'gh[pousr]_[A-Za-z0-9]{36,}') FROM t),
each AS (
  SELECT id, kind, rank, least, unnest(hit) AS hit, unnest(val) AS val, unnest(gap[1:len(hit)]) AS gap, generate_subscripts(hit, 1) AS i FROM found WHERE len(hit) > 0),
placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY id, kind ORDER BY i) AS stop FROM each),
kept AS (
  SELECT id, kind, rank, CAST(stop - length(hit) AS BIGINT) AS start, kind || ':' || CAST(stop - length(hit) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said
  FROM placed WHERE length(val) >= least),
per AS (
  SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN per USING (id)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _WORDS + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fits AS kept FROM judged",
    "op4_secret_scan": _SPANS,
    "op7_exact_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.id <> c.id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_chat_format": """
WITH r AS (
  SELECT conv_id, turn, role, text, '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|im_', '<| im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS line
  FROM conversations),
t AS (
  SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM r WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, string_agg(line, '' ORDER BY pos) AS body FROM t GROUP BY conv_id
  UNION ALL SELECT NULL, 1, line FROM r WHERE conv_id IS NULL),
d AS (SELECT min(conv_id) AS conv_id, n, body FROM c GROUP BY n, body),
m AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS o WHERE o.n > d.n AND starts_with(o.body, d.body)))
SELECT conv_id, CAST((pos - 1) // 256 AS INTEGER) AS chunk, count(*) AS n_turns, string_agg(line, '' ORDER BY pos) AS text
FROM t WHERE conv_id IN (SELECT conv_id FROM m) GROUP BY conv_id, (pos - 1) // 256
UNION ALL SELECT NULL, 0, 1, body FROM m WHERE conv_id IS NULL""",
}
