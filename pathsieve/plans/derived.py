"""The audit's tables, derived from the given ones by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TABLES = {
    "locs": "SELECT cast(page_id % 5 AS int) AS file_id, cast(page_id AS int) AS ordinal, url AS loc FROM pages",
    # order lines as URLs of a shop: four families
    "shop_urls": """
        SELECT cast(l_suppkey AS int) AS file_id, cast(l_orderkey * 8 + l_linenumber AS bigint) AS ordinal,
          CASE WHEN l_linenumber <= 3 THEN '/order/' || cast(l_orderkey AS string) || '/line/' || cast(l_linenumber AS string)
               WHEN l_linenumber <= 5 THEN '/shop/' || l_returnflag || '/' || cast(l_partkey AS string)
               WHEN l_linenumber = 6 THEN '/section-' || cast(l_suppkey AS string) || '/page/' || cast(l_orderkey AS string)
               ELSE '/about' END AS path,
          CASE WHEN l_linenumber <= 3 THEN '/order/{param}/line/{param}' WHEN l_linenumber <= 5 THEN '/shop/' || l_returnflag || '/{param}'
               WHEN l_linenumber = 6 THEN '/{param}/page/{param}' ELSE '/about' END AS family
        FROM lineitem""",
    "observation": """
        SELECT event_id AS observation_id, 's' || cast(user_id % 5 AS string) AS site_id, 'p' || cast(user_id AS string) AS pattern_id, user_id AS sample_id,
          'https://example.com/item/' || cast(event_id % 400 AS string) AS url,
          cast(CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'purchase' THEN 404 WHEN 'signup' THEN 410
            ELSE CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 429 ELSE 500 END END AS int) AS http_status,
          event_type = 'view' AND cast(regexp_extract(props, '([0-9]+)', 1) AS int) < 10 AS is_soft_404,
          (event_type = 'view' AND cast(regexp_extract(props, '([0-9]+)', 1) AS int) < 10) OR event_id % 7 = 0 AS escalated_to_get,
          cast(floor(value) AS int) AS response_ms, ts AS observed_at
        FROM events""",
    "sample": """
        SELECT site_id, pattern_id, sample_id, 1 + sample_id % 2 AS round, count(*) AS sample_size, count(*) * (1 + sample_id % 400) AS population
        FROM observation GROUP BY site_id, pattern_id, sample_id""",
    "pattern": """
        SELECT 's' || cast(p_partkey % 5 AS string) AS site_id, 'p' || cast(p_partkey AS string) AS pattern_id, 'r' || cast(p_partkey % 5 AS string) || '-' || cast(p_partkey % 3 AS string) AS run_id,
          '/' || p_type || '/{param}' AS template, cast(p_size % 8 AS int) AS segment_count, cast(1 + p_partkey * 37 % 5000 AS bigint) AS population_count, cast(1 + p_size % 4 AS int) AS file_count,
          CASE p_partkey % 7 WHEN 0 THEN 'blocked' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'sampling' ELSE 'measured' END AS status
        FROM part""",
    "pattern_population": """
        SELECT 's' || cast(l_partkey % 5 AS string) AS site_id, 'p' || cast(l_partkey AS string) AS pattern_id, cast(l_suppkey AS int) AS file_id, count(*) AS url_count
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "sitemap_file": """
        SELECT s.site_id, cast(s_suppkey AS int) AS file_id, 'r' || substr(s.site_id, 2) || '-' || cast(s_suppkey % 3 AS string) AS run_id, s_name AS filename,
          CASE WHEN s_acctbal < 0 THEN 'failed' ELSE 'parsed' END AS parse_status, cast(10 + s_suppkey AS bigint) AS url_count
        FROM supplier CROSS JOIN (SELECT DISTINCT 's' || cast(r_regionkey AS string) AS site_id FROM region) s""",
    "sitemap_run": """
        SELECT 'c' || cast(o_custkey AS string) AS site_id, 'o' || cast(o_orderkey AS string) AS run_id,
          CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'degraded' ELSE 'complete' END ELSE 'failed' END AS status,
          o_orderdate AS started_at, o_orderdate AS created_at, cast(floor(o_totalprice) AS bigint) AS total_urls, cast(o_orderkey % 9 AS int) AS total_patterns
        FROM orders""",
    "site": """
        SELECT 'c' || cast(c_custkey AS string) AS site_id, 'n' || cast(c_nationkey AS string) AS org_id, c_name AS name, lower(c_name) || '.example.com' AS host,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'priority' WHEN 'MACHINERY' THEN 'bulk' ELSE 'standard' END AS tier, c_acctbal > 0 AS is_active,
          CASE WHEN c_custkey % 11 = 0 THEN cast('2001-01-01 00:00:00' AS timestamp) END AS deleted_at
        FROM customer""",
    "probe": """
        SELECT 'h' || cast(user_id % 8 AS string) AS host, 'p' || cast(user_id AS string) AS pattern_id, event_id AS seq,
          cast(CASE WHEN user_id % 8 = 0 AND event_type <> 'error' THEN 429 WHEN event_type IN ('click', 'view') AND user_id % 3 = 0 THEN 429 WHEN event_type = 'error' THEN 403 WHEN event_id % 11 = 0 THEN 405 ELSE 200 END AS int) AS status,
          event_id % 4 = 0 AS escalated, cast(20 AS bigint) AS planned, event_id % 4 = 0 AS is_soft_404
        FROM events""",
}
#: Findings as SQL of their own, for oracles: tallies, Wilson intervals with finite population, bands, severities and impact.
ORACLE_TABLES = {
    "tally": "SELECT site_id, pattern_id, sample_id, http_status, coalesce(is_soft_404, false) AS is_soft_404, count(*) AS hits FROM observation GROUP BY ALL",
    "counted": """
        SELECT t.*, s.population, sum(hits) OVER (PARTITION BY t.sample_id) AS sampled FROM tally t JOIN sample s USING (site_id, pattern_id, sample_id)""",
    "interval1": """
        SELECT *, cast(hits AS double) / cast(sampled AS double) AS p, cast(sampled AS double) AS n, 1.959963984540054::DOUBLE AS z FROM counted WHERE http_status IS NOT NULL""",
    "interval2": """
        SELECT *, (p + (z * z / n) / 2.0::DOUBLE) / (1.0::DOUBLE + z * z / n) AS centre,
          z / (1.0::DOUBLE + z * z / n) * sqrt(p * (1.0::DOUBLE - p) / n + z * z / (4.0::DOUBLE * n * n)) AS half,
          sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE - n / cast(population AS double))) AS shrink FROM interval1""",
    "interval3": """
        SELECT *, least(least(1.0::DOUBLE, greatest(0.0::DOUBLE, p - (p - (centre - half)) * shrink)), p) AS low, greatest(least(1.0::DOUBLE, greatest(0.0::DOUBLE, p + ((centre + half) - p) * shrink)), p) AS high FROM interval2""",
    "finding0": """
        SELECT site_id, pattern_id, sample_id, http_status, is_soft_404, hits AS observed_count, sampled AS sample_size, population AS population_count,
          cast(floor(population * p + 0.5::DOUBLE) AS bigint) AS point_estimate,
          least(cast(floor(population * low + 0.5::DOUBLE) AS bigint), cast(floor(population * p + 0.5::DOUBLE) AS bigint)) AS ci_low,
          greatest(cast(floor(population * high + 0.5::DOUBLE) AS bigint), cast(floor(population * p + 0.5::DOUBLE) AS bigint)) AS ci_high, sampled >= population AS is_counted
        FROM interval3""",
    "finding1": """
        SELECT *, CASE WHEN point_estimate > 0 THEN (ci_high - ci_low) / point_estimate::DOUBLE WHEN ci_high = ci_low THEN 0 ELSE (ci_high - ci_low) / population_count::DOUBLE END AS width,
          CASE WHEN http_status IN (429, 403) THEN 'blocked' WHEN http_status = 410 THEN 'gone' WHEN http_status = 404 THEN 'not_found' WHEN http_status >= 500 THEN 'server_error'
            WHEN http_status BETWEEN 300 AND 399 THEN 'redirect_single' WHEN http_status BETWEEN 200 AND 299 THEN CASE WHEN is_soft_404 THEN 'soft_not_found' ELSE 'ok' END ELSE 'unknown' END AS severity_class
        FROM finding0""",
    "finding": """
        SELECT *, pattern_id || ':' || cast(http_status AS string) || ':' || cast(is_soft_404 AS string) AS finding_id, CASE WHEN is_counted THEN 'counted' ELSE 'estimated' END AS evidence_tier,
          CASE WHEN is_counted THEN 'confident' WHEN width < CASE WHEN point_estimate <= 0 THEN 0.02 ELSE 0.2 END THEN 'confident' WHEN width < CASE WHEN point_estimate <= 0 THEN 0.1 ELSE 0.5 END THEN 'approximate' ELSE 'low' END AS confidence_band,
          weight AS severity_weight, point_estimate * weight AS impact_score
        FROM (SELECT *, CASE severity_class WHEN 'gone' THEN 1.0::DOUBLE WHEN 'not_found' THEN 1.0::DOUBLE WHEN 'soft_not_found' THEN 0.9::DOUBLE WHEN 'server_error' THEN 0.8::DOUBLE WHEN 'redirect_single' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM finding1)""",
}


def _needed(sql: str, known: dict[str, str]) -> list[str]:
    """Names of the derived tables that a query refers to, in an order in which each follows what it needs."""
    out: list[str] = []
    for name in re.findall(r"\w+", sql):
        if name in known and name not in out:
            for n in [*_needed(known[name], {k: v for k, v in known.items() if k != name}), name]:
                if n not in out:
                    out.append(n)
    return out


def oracle(sql: str) -> str:
    """``sql`` with the derived tables it names, for DuckDB."""
    known = TABLES | ORACLE_TABLES
    parts = [f"{n} AS ({known[n]})" for n in _needed(sql, known)]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    names = [*_needed(TABLES[name], TABLES), name]
    words = {w for n in names for w in re.findall(r"\w+", TABLES[n])}
    parts = [f"{b} AS (SELECT * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in BASE if b in words]
    parts += [f"{n} AS ({TABLES[n]})" for n in names]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")
