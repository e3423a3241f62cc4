"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, exact_dedup, language, packing, passages, pii, secrets, simhash, topk, urls
from kinfold.runtime import tidy


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(passages.repeated_passages(_table(spark, sf_dir, "documents")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_documents(_table(spark, sf_dir, "documents"))
    return secrets.digest(found)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: tidy(query)
    for name, query in {
        "op1_topk": op1_topk,
        "op2_packing": op2_packing,
        "op3_simhash": op3_simhash,
        "op4_passages": op4_passages,
        "op5_secrets": op5_secrets,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_urls": op7_urls,
        "op8_bpe": op8_bpe,
        "op9_language": op9_language,
        "op10_pii": op10_pii,
    }.items()
}


def _spans_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
        SELECT blob, start, {order} AS k, stop, '{kind}' AS kind FROM (
            SELECT blob, list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN whole[1:i - 1]]), 0) AS start,
                   start + length(whole[i]) AS stop, length(part[i]) AS size
            FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
                SELECT text AS blob, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS whole, regexp_extract_all(text, {p}, {group}) AS part
                FROM texts WHERE regexp_matches(text, {p}))))
        WHERE size >= {least}"""


_SPANS = " UNION ALL ".join(_spans_sql(r.kind, r.order, r.pattern, r.group, r.least) for group in secrets.RULES.values() for r in group)

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
    "op5_secrets": f"""
        WITH texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
        spans AS ({_SPANS}),
        found AS (
            SELECT blob, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base,
                   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
            FROM spans GROUP BY blob)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN found ON blob = coalesce(text, '')""",
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)""",
    "op7_urls": r"""
        WITH RECURSIVE parts AS (
            SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(coalesce(url, ''), '(?s)^(.*?)://', 1) AS scheme,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(coalesce(url, ''), '(?s)^[^?#]*([?][^#]*)', 1) AS query FROM pages),
        tags AS (SELECT *, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM parts WHERE host <> ''),
        targets AS (
            SELECT host || path || query AS a, translate(regexp_extract(href, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                   || regexp_extract(href, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(href, '(?s)^[^?#]*([?][^#]*)', 1) AS b
            FROM (SELECT *, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS href FROM tags
                  WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical')) WHERE href LIKE '%://%'),
        edges AS (SELECT a, b FROM targets UNION SELECT b, a FROM targets),
        reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
        rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(v, h, p)),
        nodes AS (SELECT DISTINCT node, regexp_extract(node, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) AS path
                  FROM (SELECT host || path || query AS node FROM parts WHERE host <> '' UNION SELECT node FROM reach)),
        ruled AS (
            SELECT node, v, h || p AS rule FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(h || p) DESC) = 1),
        aliases AS (SELECT r.node, bool_or(v = 'allow') AS allowed, bool_or(v = 'block') AS blocked FROM reach r JOIN ruled ON ruled.node = r.other GROUP BY r.node)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
               v IS NULL AND (coalesce(allowed, false) OR coalesce(blocked, false)) AS by_alias
        FROM parts LEFT JOIN ruled ON ruled.node = host || path || query AND host <> '' LEFT JOIN aliases ON aliases.node = host || path || query AND host <> ''""",
}
