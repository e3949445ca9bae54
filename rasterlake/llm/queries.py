"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import ann, language_id, language_model, packing, pii, quality_rules, secret_scan, sentence_pieces, simhash_dedup, substring_dedup
from rasterlake.llm.common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir), F.pmod(F.crc32(F.col("doc_id").cast("string")), 10) == 0)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(documents(spark, sf_dir))


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), F.pmod(F.crc32(F.col("doc_id").cast("string")), 3) == 1)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_words(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_pii_anchors, op3_quality_rules, op4_language_model, op5_secret_scan, op6_ann_forest, op7_language_id, op8_simhash_dedup, op9_sentence_pieces, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS host FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT rid, unnest(range(1, greatest(1, len(w) - 3))) AS i, w FROM t),
key AS (SELECT rid, i, array_to_string(w[i:i+4], chr(10)) AS k FROM win),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM key),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice WHERE c > 1) GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
cl AS (SELECT rid, host, list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]{2,}|[\x09\x0B-\x0D]', ' ', 'g'), ' ')), lambda x: x <> '') AS l FROM d),
one AS (SELECT rid, host, unnest(l) AS line FROM cl),
docs AS (SELECT rid, dense_rank() OVER (ORDER BY text) AS doc FROM d),
often AS (SELECT host, line FROM one JOIN docs USING (rid) GROUP BY host, line HAVING count(DISTINCT doc) > 10),
hit AS (SELECT rid, sum(len(string_split(line, ' '))) AS n FROM one SEMI JOIN often ON one.host = often.host AND one.line = often.line GROUP BY rid),
b AS (SELECT t.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(hit.n, 0) AS f, hit.n IS NOT NULL AS h
  FROM t LEFT JOIN rep ON t.rid = rep.rid LEFT JOIN dup ON t.rid = dup.rid LEFT JOIN hit ON t.rid = hit.rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (h AND (n_words - f < 10 OR n_words - f < 0.3 * n_words)) AS kept, CAST(f AS BIGINT) AS n_frequent FROM b""",
    "op10_substring_dedup": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
key AS (SELECT rid, i, sha256(array_to_string(w[i:i+34], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 33))) AS i FROM t)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM key) WHERE c > 1),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM twice)),
words AS (SELECT rid, p, w[p] AS x FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM t)),
left_ AS (SELECT words.rid, string_agg(x, ' ' ORDER BY words.p) AS s, count(*) AS n FROM words ANTI JOIN gone ON words.rid = gone.rid AND words.p = gone.p GROUP BY words.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN left_ ON t.rid = left_.rid""",
}
