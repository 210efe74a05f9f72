"""The contract queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import html_extract, jaccard_join, langid, media, packing, piece_bpe, quality_rank, quality_rules, suffix_lm, url_filter
from docweave.llm.common import held_out, read_table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; every executor has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(read_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = held_out("doc_id", 7, 2)
    out = suffix_lm.score(docs.select("doc_id", "text"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.features(media.metadata(media.store(read_table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


#: Addresses of the contract, and pattern rules for urls that none of them fits.
URL_RULES = (
    url_filter.address_rule("allow", "org/"),
    url_filter.address_rule("block", "example.org/es/"),
    url_filter.address_rule("block", "example.org/en/1"),
    url_filter.address_rule("allow", "com/fr/"),
    url_filter.address_rule("block", "com/de/"),
    url_filter.pattern_rule("block", r"^(?:[^/?#]*\.)?ads\.", "ads"),
    url_filter.pattern_rule("block", r"^[^/?#]*/(?:[^?#]*/)?casino(?:[/.?#-]|$)", "casino"),
    url_filter.pattern_rule("block", r"^[^/?#]*/(?:[^?#]*/)?wp-login\.php(?:[?#]|$)", "wp", "login", "php"),
    url_filter.pattern_rule("block", r"^[^?#]*\.exe(?:[?#]|$)", "exe"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail
  FROM a
), c AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM b
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\.)ads\.') THEN 'block'
  WHEN regexp_matches(path, '/casino([/.-]|$)') THEN 'block'
  WHEN regexp_matches(path, '/wp-login\.php$') THEN 'block'
  WHEN regexp_matches(host || path, '\.exe$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM c
""".replace("\\\\", "\\")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = langid.train(docs, ~held_out("doc_id", 4, 2))
    return langid.predict(docs, net).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.with_base(read_table(spark, sf_dir, "documents"))


#: The base counts by lists of words and lines, and every rule of the cascade in its own words.
OP7_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents
), l AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY r, line
), lines AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM l GROUP BY r
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM t WHERE len(w) >= 8)
), again AS (
  SELECT DISTINCT r, i + k AS at FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows), range(8) o(k) WHERE n > 1
), covered AS (
  SELECT r, count(*) AS n_repeat_words FROM again GROUP BY r
), counts AS (
  SELECT t.r, doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper_, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lower_,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits
  FROM t LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
    OR 10 * n_symbols > 3 * n_words
    OR upper_ / greatest(1, upper_ + lower_) > CAST(0.6 AS DOUBLE)
    OR digits / greatest(1, word_chars) > CAST(0.4 AS DOUBLE)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM counts
"""


def op9_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality_rank.train(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return quality_rank.score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_suffix_lm": op3_suffix_lm,
        "op4_media": op4_media,
        "op5_url_filter": op5_url_filter,
        "op6_language": op6_language,
        "op7_quality_rules": op7_quality_rules,
        "op8_packing": op8_packing,
        "op9_quality_rank": op9_quality_rank,
        "op10_jaccard_join": op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op7_quality_rules": OP7_SQL}
