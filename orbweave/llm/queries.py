"""The operators over the shared tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import license_scan, line_crf, line_dedup, ngram_join, packing, pii, quality_rules, secrets, sentencepiece_codec, tiff


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir))[0]


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _vocabulary("piece_bpe_32k.model")
    # Decoded where it was encoded: a step of its own would have workers of its own, each with the words it keeps.
    decoded = sentencepiece_codec.encode_pieces(_documents(spark, sf_dir), model, decoded=True)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), _token_pattern())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, sf_dir))


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store_as_tiff(_documents(spark, sf_dir))
    # What is told of the stored form goes with the page: one file is one page here.
    told = stored.select(
        F.struct("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("of"), "media"
    )
    pages = tiff.read_tiff_columns(told, keep_col="of")
    return pages.select(
        "of.doc_id",
        "of.n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        "of.media_bytes",
        "of.media_sha256",
        "feature",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(_documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), key=pii.key_of(spark), count_col="n_replaced")


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    chain = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = line_crf.score_quality(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", F.coalesce(line_crf.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_documents(spark, sf_dir))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_join, op2_license_scan, op3_sentencepiece, op4_packing, op5_line_dedup, op6_tiff, op7_quality_rules, op8_pii, op9_line_crf, op10_secrets]
    return {f.__name__: f for f in found}


_WORDS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
  FROM documents WHERE doc_id IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
meets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT DISTINCT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id) WHERE d.doc_id IS NOT NULL
"""

OP5 = r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, unnest(range(0, greatest(len(l) - 2, 0))) AS p, l FROM lines
), hashed AS (
  SELECT doc_id, p, l[p + 1 : p + 3] AS h FROM windows
  WHERE regexp_matches(array_to_string(l[p + 1 : p + 3], ''), '[^\x20\x09-\x0D]')
), firsts AS (SELECT h, min((doc_id, p)) AS f FROM hashed GROUP BY h HAVING count(*) > 1),
marked AS (SELECT doc_id, p, (doc_id, p) <> f AS again FROM hashed JOIN firsts USING (h)),
covered AS (SELECT doc_id, unnest([p, p + 1, p + 2]) AS p, again FROM marked),
gone AS (
  SELECT doc_id, list(p) AS c
  FROM (SELECT doc_id, p FROM covered GROUP BY doc_id, p HAVING bool_and(again)) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(c), 0)::BIGINT AS n_removed,
  CASE WHEN c IS NULL THEN text
    ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(c, i)), lambda i: l[i + 1]), chr(10)), '') END AS text
FROM lines LEFT JOIN gone USING (doc_id)
"""

OP7 = rf"""
WITH base AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
), measures AS (
  SELECT b.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l FROM base) b LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (10 * n_symbols > word_chars OR 3 * n_repeat_words > n_words OR n_words = 0) AS soft_failed FROM measures
), hosts AS (SELECT host, count(*) AS d, sum((base_failed OR soft_failed)::BIGINT) AS f FROM judged GROUP BY host),
prior AS (SELECT sum(f)::DOUBLE / sum(d) AS m, sum(d * (f::DOUBLE / d) * (f::DOUBLE / d)) / sum(d) AS q, avg(d) AS docs FROM hosts),
weighted AS (SELECT m, CASE WHEN q - m * m > 1e-9 THEN greatest(m * (1 - m) / (q - m * m) - 1, 1.0) ELSE docs END AS k FROM prior),
verdicts AS (SELECT host, (f + m * k) / (d + k) AS rate, (f + m * k) / (d + k) > m + sqrt(m * (1 - m) / (k + 1)) + 1e-12 AS bad FROM hosts, weighted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT (bad AND soft_failed)) AS kept, j.host, bad AS host_rejected, round(rate, 9) AS host_rate
FROM judged j JOIN verdicts v ON j.host IS NOT DISTINCT FROM v.host
"""


def _op2_sql() -> str:
    templates = [(label, phrase, "true") for label, phrase in license_scan.PHRASES] + [(label, notice, "false") for label, notice in license_scan.NOTICES]
    rows = ", ".join(f"({k}, '{label}', {exact}, '{words}')" for k, (label, words, exact) in enumerate(templates))
    return rf"""
WITH templates AS (SELECT tid, label, exact, string_split(said, ' ') AS t FROM (VALUES {rows}) v(tid, label, exact, said)),
tgrams AS (SELECT tid, label, exact, (len(t) - 2) AS n_grams, i AS t_pos, array_to_string(t[i + 1 : i + 3], ' ') AS g
  FROM (SELECT *, unnest(range(0, len(t) - 2)) AS i FROM templates)),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), grams AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 0))) AS p FROM words)),
votes AS (
  SELECT doc_id, tid, p - t_pos AS diagonal, any_value(label) AS label, any_value(exact) AS exact, any_value(n_grams) AS n_grams,
    count(DISTINCT t_pos) AS votes, min(p) AS lo, max(p) AS hi
  FROM grams JOIN tgrams USING (g) GROUP BY 1, 2, 3
), marked AS (
  SELECT *, CASE WHEN NOT exact AND diagonal - lag(diagonal) OVER o <= 2
      AND lo <= max(hi) OVER (PARTITION BY doc_id, tid ORDER BY diagonal, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS opens
  FROM votes WINDOW o AS (PARTITION BY doc_id, tid ORDER BY diagonal, lo)
), chained AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, tid ORDER BY diagonal, lo ROWS UNBOUNDED PRECEDING) AS chain FROM marked),
spans AS (
  SELECT doc_id, tid, chain, any_value(label) AS label, any_value(exact) AS exact, min(lo)::BIGINT AS b, least(sum(votes)::DOUBLE / any_value(n_grams), 1.0) AS coverage
  FROM chained GROUP BY 1, 2, 3
), whole AS (SELECT * FROM spans WHERE CASE WHEN exact THEN coverage = 1.0 ELSE coverage >= 0.8 END),
per AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(b) FILTER (exact) AS first_word, max(b) FILTER (exact) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(coverage) AS score
  FROM whole GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN per USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op2_license_scan": _op2_sql(), "op5_line_dedup": OP5, "op7_quality_rules": OP7}
