"""Queries of the training-data operators, and DuckDB SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, langid, mixing, quality, secrets, sharding, simhash, substring, tokens, urls
from weftgraph.llm.common import stage, table


def _decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", F.round("containment", 9).alias("containment"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.policy_mask("base"))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 costs, from the stored ledger's bits; no text is read again."""
    return quality.ablation(stage(quality.ledger(table(spark, sf_dir, "documents")).select("doc_id", "fail_bits")))


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.classify(table(spark, sf_dir, "documents")))


def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shard(narrow, shards=8, text="text_crc32").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(tokens.TOKENIZER))


def _substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_passages(table(spark, sf_dir, "documents"), with_text=False).withColumnRenamed("kept", "kept_sha256")


def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def mixing_dims(docs: DataFrame) -> dict:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"), F.col("lang"), mixing.keywords(docs))}


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    drawn, at = mixing.mix(docs, mixing_dims(docs), mixing.token_count(F.col("text")))
    return drawn.select(
        "doc_id", F.col(at["tokens"]).alias("n_tokens"), F.col(at["topic"]).alias("topic"), F.round(at["rate"], 6).alias("weight"),
        F.round(at["prob"], 6).alias("prob"), F.col(at["kept"]).alias("kept"),
    )


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return urls.evaluate(pages, urls.synthetic_list(pages), fetched=fetched).select("page_id", fetched.cast("string").alias("fetched"), "n_matches", "pattern", "blocked")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": _decontaminate,
    "op2_quality_rules": _quality,
    "op3_secret_scans": _secrets,
    "op4_sharding": _sharding,
    "op5_token_counts": _tokens,
    "op6_substring_dedup": _substring,
    "op7_language_id": _langid,
    "op8_simhash": _simhash,
    "op9_mixing": _mixing,
    "op10_url_filters": _urls,
    "quality_ablation": _ablation,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LEDGER = rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM documents),
        g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') s FROM d, unnest(range(1, len(w) - 3)) t(i)),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) c FROM g) WHERE c > 1),
        c AS (SELECT doc_id, count(DISTINCT i + j) k FROM r, unnest(range(0, 5)) t(j) GROUP BY 1),
        m AS (SELECT d.doc_id, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT n_symbols,
            (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines, coalesce(k, 0)::BIGINT n_repeat_words, len(regexp_extract_all(text, '[A-Z]'))::BIGINT n_upper, len(l)::BIGINT n_lines
            FROM d LEFT JOIN c USING (doc_id)),
        f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
            + 8 * (n_lines >= 6 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars > 20 * n_words OR word_chars < 2 * n_words)::BIGINT
            + 32 * (10 * n_upper > 4 * word_chars)::BIGINT AS fail_bits FROM m)"""

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM benchmark),
        i AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') s FROM b, unnest(range(1, len(w) - 3)) t(i)),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') s FROM d, unnest(range(1, len(w) - 3)) t(i)),
        q AS (SELECT item_id, count(*) AS q FROM i GROUP BY 1),
        m AS (SELECT doc_id, item_id, count(*) AS k FROM s JOIN i USING (s) GROUP BY 1, 2)
        SELECT doc_id, item_id, k AS n_shared, q AS n_shingles, round(k / q, 9) AS containment FROM m JOIN q USING (item_id) WHERE 10 * k >= 8 * q
    """,
    "op2_quality_rules": _LEDGER + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
    """,
    "quality_ablation": _LEDGER + """,
        rules AS (SELECT unnest(['min_words', 'repeated_windows', 'symbols', 'dup_lines', 'word_length', 'upper_case']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
        SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_failed_alone, count(*) FILTER (fail_bits & ~bit::BIGINT = 0) AS n_kept_without FROM f, rules GROUP BY 1
    """,
    "op6_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') s FROM d, unnest(range(1, len(w) - 48)) t(i)),
        r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) lo FROM g) WHERE lo < doc_id),
        c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, unnest(range(0, 50)) t(j)),
        cut AS (SELECT doc_id, list(p) ps FROM c GROUP BY 1),
        p AS (SELECT doc_id, w, ps, CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k)) END kept FROM d LEFT JOIN cut USING (doc_id))
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM p
    """,
    "op10_url_filters": r"""
        WITH u AS (SELECT page_id, (DATE '2024-01-01' + (page_id % 366)::INT)::DATE AS d,
            nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') h,
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)', 1) s FROM pages),
        m AS (SELECT DISTINCT h, md5(h) m FROM u WHERE h IS NOT NULL),
        a AS (SELECT h, m, (DATE '2024-01-01' + (('0x' || substr(m, 2, 2))::INT))::DATE d0 FROM m),
        i AS (SELECT h AS pattern, d0 AS since, CASE WHEN substr(m, 4, 1) < '8' THEN (d0 + 90)::DATE ELSE DATE '9999-12-31' END AS until FROM a WHERE substr(m, 1, 1) < '8'
                AND h NOT IN ('spam-farm.example.org', 'cheap-pills.example.com')
            UNION ALL SELECT h || '/en', DATE '2024-03-01', DATE '9999-12-31' FROM a WHERE substr(m, 5, 1) < '4'
            UNION ALL SELECT p, DATE '2024-01-01', coalesce((SELECT min((d0 + 90)::DATE) FROM a WHERE h = p AND substr(m, 1, 1) < '8' AND substr(m, 4, 1) < '8'), DATE '9999-12-31')
                FROM (VALUES ('spam-farm.example.org'), ('cheap-pills.example.com')) t(p)),
        hit AS (SELECT page_id, pattern FROM u JOIN i ON (u.h = pattern OR ends_with(u.h, '.' || pattern) OR (s <> '' AND u.h || '/' || s = pattern)) AND d >= since AND d < until),
        best AS (SELECT page_id, count(*) n, max(lpad(length(pattern)::VARCHAR, 6, '0') || pattern) p FROM hit GROUP BY 1)
        SELECT page_id, d::VARCHAR AS fetched, coalesce(n, 0)::BIGINT AS n_matches, substr(p, 7) AS pattern, n IS NOT NULL AS blocked FROM u LEFT JOIN best USING (page_id)
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
