"""The registered queries of the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` has neither fetch days nor lists: both are derived from its identifiers, hosts and paths."""
    from .url_filters import filter_urls, host, path

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 365) as int))"))
    seen = pages.select(host(F.col("url")).alias("host"), F.lower(F.get(F.split(path(F.col("url")), "/"), 1)).alias("first")).filter("host <> ''").distinct()
    rules = seen.selectExpr(
        """stack(3, 'host', host, 'domain', concat_ws('.', slice(split(host, '[.]'), greatest(size(split(host, '[.]')) - 1, 1), 2)),
                    'path', if(first <> '', concat(host, '/', first), null)) as (kind, rule)"""
    )
    rules = rules.filter("rule is not null").distinct().withColumn("h", F.expr("cast(conv(substr(md5(rule), 1, 6), 16, 10) as bigint)"))
    entries = rules.selectExpr("rule", "kind", "h", "stack(3, 1, 2, 3) as nth").selectExpr(
        "rule",
        """case when kind = 'host' and h % 3 = 0 then get(array('block', 'removed'), nth - 1)
                when kind = 'domain' then get(array('block', 'allow', 'removed'), nth - 1)
                when kind = 'path' and h % 5 = 0 and nth = 1 then 'allow' end as verdict""",
        "cast(case kind when 'host' then h % 300 + (nth - 1) * (30 + h % 60) when 'domain' then h % 200 + get(array(0, 90, 150), nth - 1) else h % 365 end as int) as d",
    )
    return filter_urls(captures, entries.selectExpr("rule", "verdict", "date_add(date'2024-01-01', d) as day"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), least_percent=85).drop("text_sha256")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe

    return bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_personal_data, op3_quality_classifier, op4_hmm_scores, op5_mix_sources, op6_secret_scan, op7_exact_dedup, op8_minhash_near_dedup, op9_fingerprints, op10_bpe)}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": r"""
        WITH pg AS (
            SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS DATE) AS fetched,
                   rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host,
                   list_filter(string_split(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)), '/'), lambda s: s <> '') AS segs,
                   string_split(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)), '/')[2] AS first
            FROM pages),
        rules AS (
            SELECT DISTINCT kind, rule, CAST('0x' || substr(md5(rule), 1, 6) AS BIGINT) AS h FROM (
                SELECT 'host' AS kind, host AS rule FROM pg WHERE host <> ''
                UNION ALL SELECT 'domain', array_to_string(string_split(host, '.')[-2:], '.') FROM pg WHERE host <> ''
                UNION ALL SELECT 'path', host || '/' || first FROM pg WHERE host <> '' AND first <> '')),
        log AS (
            SELECT rule, 'block' AS verdict, h % 300 AS d FROM rules WHERE kind = 'host' AND h % 3 = 0
            UNION SELECT rule, 'removed', h % 300 + 30 + h % 60 FROM rules WHERE kind = 'host' AND h % 3 = 0
            UNION SELECT rule, 'block', h % 200 FROM rules WHERE kind = 'domain'
            UNION SELECT rule, 'allow', h % 200 + 90 FROM rules WHERE kind = 'domain'
            UNION SELECT rule, 'removed', h % 200 + 150 FROM rules WHERE kind = 'domain'
            UNION SELECT rule, 'allow', h % 365 FROM rules WHERE kind = 'path' AND h % 5 = 0),
        spans AS (
            SELECT rule, verdict, CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS DATE) AS since,
                   CAST(DATE '2024-01-01' + CAST(lead(d) OVER (PARTITION BY rule ORDER BY d, verdict) AS INTEGER) AS DATE) AS until
            FROM log),
        hits AS (
            SELECT p.page_id, s.verdict, s.rule, s.since,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY (contains(s.rule, '/')) DESC, length(s.rule) DESC) AS rn
            FROM pg p JOIN spans s
              ON (p.host = s.rule OR ends_with(p.host, '.' || s.rule) OR (len(p.segs) > 0 AND p.host || '/' || p.segs[1] = s.rule))
             AND s.verdict <> 'removed' AND s.since <= p.fetched AND (s.until IS NULL OR p.fetched < s.until))
        SELECT pg.page_id, pg.url, pg.fetched, h.verdict, h.rule, h.since
        FROM pg LEFT JOIN hits h ON pg.page_id = h.page_id AND h.rn = 1""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                           ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS shingles
            FROM w),
        e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
        SELECT s.doc_id, len(s.shingles) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""",
}
