"""Registered queries of the training-data operators and, where DuckDB can
express them, their SQL. Every query reads its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm import (ann, edit_counts, hard_negatives, hmm_lm, lang_id, lexicon_bpe, line_rules, mixing, packing, quality,
                          simhash, spelling, suffix_dedup)
from almagest.sources.tables import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(spark, read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, read(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return ann.nearest(spark, rows, rows.filter("vec_id % 50 = 0"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(spark, read(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(spark, read(spark, sf_dir, "documents"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(spark, read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.in_order(spark, mixing.plan(spark, read(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken",
                       F.try_element_at("positions", F.lit(1)).alias("position"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count_ruled(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spark, read(spark, sf_dir, "documents"))


def op12_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_bpe.digests(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    wrong = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    return hard_negatives.mine(spark, rows.withColumn("label", wrong), F.expr("vec_id % 50 = 0"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_simhash, op3_nearest, op4_quality, op5_hmm_lm, op6_language, op7_line_rules, op8_mixing,
    op9_packing, op10_edit_counts, op11_spelling_variants, op12_lexicon_bpe,
    op13_hard_negatives)}

#: One word, as a pattern of DuckDB.
_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS m FROM d, unnest(range(0, greatest(n - 399, 0))) AS t(p)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
f AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400, true) AS fresh FROM r),
g AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM f),
s AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM s
      UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), max(n) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
left_over AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept
              FROM k JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS runs FROM s GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
       sha256(unhex(kept)) AS kept_sha256
FROM d JOIN left_over USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

_OP3 = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_cosine_similarity(a.v, b.v) AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
lines AS (SELECT doc_id, source, l FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
often_g AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM often_g, unnest([0, 1, 2]) AS u(o) GROUP BY doc_id),
norm AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l
         FROM lines),
often AS (SELECT source, l FROM norm GROUP BY source, l HAVING count(DISTINCT doc_id) > 50),
lost AS (SELECT doc_id, sum(len(string_split(norm.l, ' '))) AS n
         FROM norm JOIN often ON norm.l = often.l AND norm.source IS NOT DISTINCT FROM often.source GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(lost.n, 0)::BIGINT AS n_removed_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_removed_words >= 50 AND n_words - n_removed_words >= 0.5 * n_words AS kept, n_removed_words
FROM c
"""

_OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS queue FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
        FROM d GROUP BY source),
s AS (SELECT source, source_size, [3.0, 1.0, 2.0][(rank % 3 + 1)::INT]::DOUBLE AS weight,
             [-0.5, 0.0, 0.5][(rank % 3 + 1)::INT]::DOUBLE AS slope FROM src),
lev AS (SELECT 0 AS i, -1.0::DOUBLE AS level
        UNION ALL
        SELECT i + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2 * source_size) FILTER (weight * lev.level > 2 * source_size), 0))
                              / sum(weight) FILTER (weight * lev.level <= 2 * source_size) FROM s)
        FROM lev WHERE i < 40),
goal AS (SELECT s.*, least(weight * (SELECT max(level) FROM lev), (2 * source_size)::DOUBLE) AS target FROM s),
q AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.slope,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY queue, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size + d.size / 2.0::DOUBLE AS middle,
             CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS passes
      FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CASE WHEN size > 0 THEN passes + (middle <= target - passes * source_size)::INT ELSE 0 END AS copies,
             least(middle / target, 1.0::DOUBLE) AS u FROM q)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN 2 * u / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) END AS position
FROM c
"""

_OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END,
                                                          i)) AS step),
runs AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)
         GROUP BY ALL),
sums AS (SELECT w, n, xor(4294967295, list_reduce(
             list_transform(range(strlen(k)), lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::BIGINT),
             lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h
         FROM (SELECT w, n, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM runs), crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM sums),
v AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM v, unnest(range(length(word))) AS t(i)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, v.word FROM cut a JOIN v ON a.less = v.word
          UNION SELECT v.word, a.word FROM cut a JOIN v ON a.less = v.word),
near AS (SELECT p.a AS word, count(*) AS n_near, arg_min(struct_pack(form := p.b, form_n := v.n), (-v.n, encode(p.b))) AS f
         FROM pairs p JOIN v ON v.word = p.b GROUP BY p.a),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.form_n >= 5 * v.n THEN f.form END AS form,
                 CASE WHEN f.form_n >= 5 * v.n THEN f.form_n END AS form_n
          FROM v LEFT JOIN near USING (word)),
chain AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL
          UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, coalesce(ends.at, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""

_OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE: dict[str, str] = {"op1_suffix_dedup": _OP1, "op3_nearest": _OP3, "op7_line_rules": _OP7, "op8_mixing": _OP8,
                          "op11_spelling_variants": _OP11, "op13_hard_negatives": _OP13}
