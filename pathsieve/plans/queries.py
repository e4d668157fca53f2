"""Registered queries of the audit's operators over the given tables, with equivalent SQL."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.functions import status as st
from pathsieve.functions import urls as ur
from pathsieve.operators import checks, estimate, passes, patterns, probes, reports, sampling, upserts
from pathsieve.plans.derived import oracle, table
from pathsieve.plans.strata_sql import CIRCUITS, VERDICTS, allocation, expansion, measured
from pathsieve.sources import sitemaps, tables

FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
HOST = "lower(regexp_extract(trim({x}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
PATH = "regexp_extract({x}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
SHAPE = "regexp_replace(regexp_replace(regexp_replace({x}, '[A-Za-z]+', 'a', 'g'), '[0-9]', '9', 'g'), '9{{13,}}', '999999999999', 'g')"
SEGMENTS = "list_filter(string_split(" + PATH + ", '/'), lambda s: s <> '')"
CRITICAL = "('gone', 'not_found', 'soft_not_found', 'server_error', 'redirect_chain')"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return keep


def _own_host(url):
    return F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1)


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    locs = table(spark, sf, "locs")
    return locs.withColumn("p", ur.parse_loc(F.col("loc"), F.lit("https://example.com/"), _own_host(F.col("loc")))).select("file_id", "ordinal", "loc", "p.*")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    f = estimate.build_findings(table(spark, sf, "observation"), table(spark, sf, "sample").select("site_id", "pattern_id", "sample_id", "population"))
    return f.withColumn("finding_id", F.concat_ws(":", "pattern_id", F.col("http_status").cast("string"), F.col("is_soft_404").cast("string")))


# sources and exports

LIMITS = ((100.0, None, 50_000), (1e12, None, 50_000), (1e12, 100.0, 50_000), (100.0, 100.0, 5))
ASSESSED = " UNION ALL ".join(f"SELECT {k} AS k, files, urls, CASE WHEN files > {most} THEN 'HARD_LIMIT_FILES' WHEN urls > {hard or 1e18} THEN 'HARD_LIMIT_URLS' WHEN urls > {soft} THEN 'OVERSIZE_SOFT_LIMIT' END AS reason, {soft}::DOUBLE AS soft FROM t" for k, (soft, hard, most) in enumerate(LIMITS))


@query("a5_assess_size", f"SELECT * FROM (WITH t AS (SELECT count(*) AS files, cast(sum(url_count) AS bigint) AS urls FROM sitemap_file), v AS ({ASSESSED}) SELECT k, files, urls, reason, CASE WHEN reason IS NULL THEN 'ok' WHEN reason = 'OVERSIZE_SOFT_LIMIT' THEN 'degraded' ELSE 'stop' END AS verdict, round(CASE WHEN reason = 'OVERSIZE_SOFT_LIMIT' THEN greatest(0.1::DOUBLE, soft / urls) ELSE 1 END, 8) AS sample_multiplier FROM v)")
def _(spark, sf):
    made = None
    for k, (soft, hard, most) in enumerate(LIMITS):
        one = sitemaps.assess_size(table(spark, sf, "sitemap_file"), soft_urls=soft, hard_urls=hard, hard_files=most).withColumns({"k": F.lit(k), "sample_multiplier": F.round("sample_multiplier", 8)})
        made = one if made is None else made.unionByName(one)
    return made


@query("a6_url_lines", "SELECT file_id, line, trim(raw) AS url FROM (SELECT doc_id AS file_id, unnest(range(0, len(l))) AS line, unnest(l) AS raw FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents)) WHERE trim(raw) <> ''")
def _(spark, sf):
    return sitemaps.read_url_lines(table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("value")))


@query("a6_line_counts", "SELECT count(*) AS submitted, count(*) FILTER (trim(raw) = '') AS blank, count(*) FILTER (trim(raw) <> '') AS analysed FROM (SELECT unnest(string_split_regex(text, '\\r?\\n')) AS raw FROM documents)")
def _(spark, sf):
    return sitemaps.line_counts(table(spark, sf, "documents").select(F.col("text").alias("value")))


@query("a8_observation_rows", "SELECT url, pattern_id AS pattern, http_status, 'HEAD' AS method, escalated_to_get, is_soft_404, cast(NULL AS string) AS error_reason, response_ms, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS observed_at FROM observation")
def _(spark, sf):
    o = table(spark, sf, "observation").withColumns({"pattern": F.col("pattern_id"), "method": F.lit("HEAD"), "error_reason": F.lit(None).cast("string")})
    return tables.observation_rows(o)


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC NULLS LAST, created_at DESC, run_id DESC) AS n FROM sitemap_run) WHERE n = 1"
STATE = "CASE WHEN r.status IS NULL THEN 'never_run' WHEN r.status IN ('pending', 'running') THEN 'in_flight' WHEN r.total_urls = 0 THEN 'no_urls' ELSE 'measured' END"
PORTFOLIO = f"""SELECT s.site_id, s.name, s.host, s.tier, {STATE} AS state, r.run_id, r.status AS run_status, r.started_at, r.total_urls, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, cast('2024-01-01' AS timestamp) AS created_at
    FROM site s LEFT JOIN ({LATEST}) r USING (site_id) LEFT JOIN (SELECT 'c' || substr(pattern_id, 2) AS site_id, count(*) AS total, count(*) FILTER (severity_class IN {CRITICAL}) AS critical FROM finding GROUP BY 1) f USING (site_id)
    WHERE s.is_active AND s.deleted_at IS NULL"""


def portfolio_rows(spark, sf):
    """The portfolio; a pattern's findings count for the site of its number."""
    sites = table(spark, sf, "site").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    own = findings(spark, sf).withColumn("site_id", F.concat(F.lit("c"), F.substring("pattern_id", 2, 20)))
    return reports.portfolio(sites, table(spark, sf, "sitemap_run"), own)


@query("a9_portfolio_rows", PORTFOLIO)
def _(spark, sf):
    return portfolio_rows(spark, sf).select(*tables.PORTFOLIO_COLUMNS)


@query("k6_fleet_totals", f"SELECT count(*) AS sites, count(*) FILTER (state = 'in_flight') AS in_flight, count(*) FILTER (run_status IN ('degraded', 'failed')) AS degraded_or_failed, cast(coalesce(sum(total_urls), 0) AS bigint) AS urls, cast(sum(total) AS bigint) AS findings, cast(sum(critical) AS bigint) AS critical, count(*) FILTER (total > 0) AS sites_affected, count(*) FILTER (created_at >= cast('2024-01-20' AS timestamp) - INTERVAL 30 DAYS) AS onboarded_30_days FROM ({PORTFOLIO})")
def _(spark, sf):
    return reports.fleet_totals(portfolio_rows(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz"))


# sitemap files made of the pages' URLs: 25 to a file, in five forms

STYLE = "floor(page_id / 25) % 5"


def sitemap_files(spark, sf):
    """(path, content): plain, after a warning, with a prefix, an index, and no sitemap at all."""
    pages = table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 25).alias("file"), "url")
    loc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    style = F.col("file") % 5
    item = F.when(style == 2, F.concat(F.lit("<s:url><s:loc>"), loc, F.lit("</s:loc></s:url>"))).when(style == 3, F.concat(F.lit("<sitemap><loc>"), loc, F.lit("</loc></sitemap>"))).when(style == 4, F.lit("nothing ")).otherwise(F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>")))
    head = F.when(style == 0, "<?xml version='1.0'?><urlset>").when(style == 1, "Warning: x.php\n<?xml version='1.0'?><urlset>").when(style == 2, "<s:urlset xmlns:s='x'>").when(style == 3, "<sitemapindex>").otherwise("")
    tail = F.when(style == 2, "</s:urlset>").when(style == 3, "</sitemapindex>").when(style == 4, "").otherwise("</urlset>")
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))), lambda x: x["item"]), "")
    made = pages.groupBy("file").agg(items.alias("items"))
    return made.select(F.concat(F.lit("file-"), F.col("file").cast("string")).alias("path"), F.concat(head, "items", tail).cast("binary").alias("content"))


LOCS_OF_FILES = f"""SELECT 'file-' || cast(floor(page_id / 25) AS bigint) AS file_url, CASE {STYLE} WHEN 3 THEN 'sitemapindex' ELSE 'urlset' END AS root_element,
    cast(row_number() OVER (PARTITION BY floor(page_id / 25) ORDER BY page_id) - 1 AS int) AS ordinal, url AS loc, {STYLE} = 1 AS had_preamble, NULL::VARCHAR AS error FROM pages WHERE {STYLE} <> 4
    UNION ALL SELECT DISTINCT 'file-' || cast(floor(page_id / 25) AS bigint), NULL, NULL, NULL, false, 'NON_XML_PREAMBLE' FROM pages WHERE {STYLE} = 4"""


@query("a1_parse_sitemaps", LOCS_OF_FILES)
def _(spark, sf):
    """Locations of all files; the plain ones are compressed, which their names don't say."""
    def packed(content: pd.Series) -> pd.Series:
        return content.map(gzip.compress)

    files = sitemap_files(spark, sf)
    plain = F.pandas_udf(packed, "binary")(F.col("content"))
    return sitemaps.parse_sitemaps(files.where("content like '<?xml%'").select("path", plain.alias("content")).unionByName(files.where("content not like '<?xml%'")))


FORMS = f"""SELECT 'file-' || cast(floor(page_id / 25) AS bigint) AS path, any_value({STYLE}) AS style, count(*) AS n, string_agg(CASE {STYLE} WHEN 2 THEN '<s:url><s:loc>' || replace(url, '&', '&amp;') || '</s:loc></s:url>' WHEN 3 THEN '<sitemap><loc>' || replace(url, '&', '&amp;') || '</loc></sitemap>' WHEN 4 THEN 'nothing ' ELSE '<url><loc>' || replace(url, '&', '&amp;') || '</loc></url>' END, '' ORDER BY page_id) AS items FROM pages GROUP BY 1"""
WHOLE = "CASE style WHEN 0 THEN '<?xml version=''1.0''?><urlset>' WHEN 1 THEN 'Warning: x.php' || chr(10) || '<?xml version=''1.0''?><urlset>' WHEN 2 THEN '<s:urlset xmlns:s=''x''>' WHEN 3 THEN '<sitemapindex>' ELSE '' END || items || CASE style WHEN 2 THEN '</s:urlset>' WHEN 3 THEN '</sitemapindex>' WHEN 4 THEN '' ELSE '</urlset>' END"


@query("a7_file_inventory", f"SELECT path, octet_length(encode(content)) AS byte_size, sha256(content) AS sha256, false AS is_gzip, CASE style WHEN 4 THEN 0 ELSE n END AS url_count, CASE style WHEN 4 THEN 'NON_XML_PREAMBLE' END AS parse_error, CASE style WHEN 4 THEN 'failed' ELSE 'parsed' END AS parse_status FROM (SELECT *, {WHOLE} AS content FROM ({FORMS}))")
def _(spark, sf):
    files = sitemap_files(spark, sf)
    return sitemaps.file_inventory(files, sitemaps.parse_sitemaps(files)).withColumn("byte_size", F.col("byte_size").cast("long"))


def sitemap_graph(spark, sf):
    """(entry, locs): an index for each region, naming one for each nation, naming a file for each supplier."""
    region, nation, supplier = (table(spark, sf, n) for n in ("region", "nation", "supplier"))
    named = [
        nation.select(F.format_string("region/%d", "n_regionkey").alias("file_url"), F.col("n_nationkey").cast("int").alias("ordinal"), F.format_string("nation/%d", "n_nationkey").alias("loc")),
        supplier.select(F.format_string("nation/%d", "s_nationkey").alias("file_url"), F.col("s_suppkey").cast("int").alias("ordinal"), F.format_string("supplier/%d", "s_suppkey").alias("loc")),
        # each nation names its region again, which is reached already
        nation.select(F.format_string("nation/%d", "n_nationkey").alias("file_url"), F.lit(-1).alias("ordinal"), F.format_string("region/%d", "n_regionkey").alias("loc")),
    ]
    locs = named[0].unionByName(named[1]).unionByName(named[2]).withColumn("root_element", F.lit("sitemapindex"))
    return region.select(F.format_string("region/%d", "r_regionkey").alias("file_url")), locs


#: Level by level in the order of the walk: how many files there would be with an index's children, and the place of the first index where they are too many.
EXPANDED = """SELECT * FROM (WITH r AS (SELECT 'region/' || r_regionkey AS file_url, r_regionkey AS k, count(n_nationkey) AS c FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2),
    rw AS (SELECT *, row_number() OVER (ORDER BY file_url) AS place, (SELECT count(*) FROM region) + coalesce(sum(c) OVER (ORDER BY file_url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c AS would FROM r),
    rs AS (SELECT min(place) AS stop FROM rw WHERE c > 0 AND would > 50000),
    n AS (SELECT 'nation/' || n_nationkey AS file_url, n_nationkey AS k, 1 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS c, row_number() OVER (ORDER BY rw.place, n_nationkey) AS place FROM nation JOIN rw ON rw.k = n_regionkey CROSS JOIN rs WHERE stop IS NULL OR rw.place < stop),
    nw AS (SELECT *, (SELECT count(*) FROM region) + (SELECT count(*) FROM n) + coalesce(sum(c - 1) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c AS would FROM n),
    ns AS (SELECT CASE WHEN (SELECT stop FROM rs) IS NULL THEN (SELECT min(place) FROM nw WHERE would > 50000) ELSE 0 END AS stop),
    f AS (SELECT *, 0 AS depth FROM rw CROSS JOIN rs UNION ALL SELECT *, 1 FROM nw CROSS JOIN ns)
    SELECT file_url, depth, CASE WHEN c > 0 AND (stop IS NULL OR place <= stop) THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN place = stop THEN 'NESTED_SITEMAP_INDEX_OVER_LIMIT' WHEN c > 0 AND (stop IS NULL OR place < stop) THEN 'NESTED_SITEMAP_INDEX' END AS reason, CASE WHEN c > 0 AND (stop IS NULL OR place <= stop) THEN c END AS children FROM f
    UNION ALL SELECT 'supplier/' || s_suppkey, 2, 'pending', NULL, NULL FROM supplier JOIN nw ON nw.k = s_nationkey CROSS JOIN ns WHERE stop IS NULL OR place < stop)"""


@query("a4_expand_indexes", EXPANDED)
def _(spark, sf):
    """At most 50 000 files, as the walk has it; the suppliers of the first nation that would bring more aren't reached, nor what comes after it."""
    return sitemaps.expand_sitemap_indexes(*sitemap_graph(spark, sf))


@query("a4_over_limit", """SELECT * FROM (WITH r AS (SELECT 'region/' || r_regionkey AS file_url, r_regionkey AS k, count(n_nationkey) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2),
    w AS (SELECT *, (SELECT count(*) FROM region) + coalesce(sum(children) OVER (ORDER BY file_url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + children AS would FROM r),
    f AS (SELECT min(file_url) AS first FROM w WHERE would > 18)
    SELECT file_url, 0 AS depth, CASE WHEN file_url <= first THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN file_url < first THEN 'NESTED_SITEMAP_INDEX' WHEN file_url = first THEN 'NESTED_SITEMAP_INDEX_OVER_LIMIT' END AS reason, CASE WHEN file_url <= first THEN children END AS children FROM w, f
    UNION ALL SELECT 'nation/' || n_nationkey, 1, 'pending', NULL, NULL FROM nation, f WHERE 'region/' || n_regionkey < first)""")
def _(spark, sf):
    """With a limit of 18 files the third region's nations are too many."""
    return sitemaps.expand_sitemap_indexes(*sitemap_graph(spark, sf), 18)


@query("a10_write_partitioned", "SELECT site_id, pattern_id, file_id, url_count FROM pattern_population")
def _(spark, sf):
    """A table written by site and read back."""
    from pathsieve.streaming.runs import _folder

    path = _folder(spark)
    tables.write_partitioned(table(spark, sf, "pattern_population").select("site_id", "pattern_id", "file_id", "url_count"), path)
    return spark.read.parquet(path)


# scalar functions

@query("b1_normalize_host", f"SELECT page_id, regexp_replace({HOST.format(x='url')}, '^www\\.', '') AS host FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", ur.normalize_host(_own_host(F.col("url"))).alias("host"))


#: Locations in every form: as they are, relative, without scheme, with a fragment, blank, on another host.
FORMED = "SELECT ordinal, file_id, CASE ordinal % 7 WHEN 0 THEN loc WHEN 1 THEN regexp_extract(loc, '^[a-z]+://[^/]*(.*)$', 1) WHEN 2 THEN regexp_extract(loc, '^[a-z]+:(.*)$', 1) WHEN 3 THEN '  ' || loc || '#top ' WHEN 4 THEN '  ' WHEN 5 THEN 'https://www.other.example.org/x/' || cast(ordinal AS string) ELSE '?q=' || cast(ordinal AS string) END AS loc, regexp_extract(loc, '^[a-z]+://([^/?#:]+)', 1) AS host FROM locs"


@query("b2_parse_loc", f"""SELECT ordinal, CASE ordinal % 7 WHEN 4 THEN 'unparseable' WHEN 5 THEN 'foreign' ELSE 'matched' END AS kind,
    CASE WHEN ordinal % 7 = 6 THEN '/base/?q=' || cast(ordinal AS string) WHEN ordinal % 7 NOT IN (4, 5) THEN {PATH.format(x='loc')} || regexp_extract(regexp_replace(loc, '#.*$', ''), '(\\?.+)$', 1) END AS path,
    CASE WHEN ordinal % 7 = 6 THEN 1 WHEN ordinal % 7 NOT IN (4, 5) THEN len({SEGMENTS.format(x='loc')}) END AS n_segments, CASE WHEN ordinal % 7 = 5 THEN 'other.example.org' END AS detected_host FROM locs""")
def _(spark, sf):
    table(spark, sf, "locs").createOrReplaceTempView("locs_of_pages")
    rows = spark.sql(FORMED.replace("FROM locs", "FROM locs_of_pages"))
    p = rows.select("ordinal", ur.parse_loc(F.col("loc"), F.concat(F.lit("http://"), "host", F.lit("/base/")), F.col("host")).alias("p")).select("ordinal", "p.*")
    return p.select("ordinal", "kind", "path", F.when(F.col("segments").isNotNull(), F.size("segments")).alias("n_segments"), "detected_host")


@query("b3_stable_hash", f"SELECT page_id, {FNV.format(x='url')} AS hash FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", ur.stable_hash(F.col("url")).alias("hash"))


@query("b3_stable_hash_sql", f"SELECT page_id, {FNV.format(x='url')} AS hash, {SHAPE.format(x='url')} AS shape FROM pages")
def _(spark, sf):
    ur.register(spark)
    return table(spark, sf, "pages").selectExpr("page_id", "stable_hash(url) AS hash", "value_shape(url) AS shape")


@query("b4_value_shape", f"SELECT page_id, {SHAPE.format(x='url')} AS shape FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", ur.value_shape(F.col("url")).alias("shape"))


@query("b5_path_shape", f"SELECT ordinal, file_id, {SHAPE.format(x='path')} AS shape FROM shop_urls")
def _(spark, sf):
    return table(spark, sf, "shop_urls").select("ordinal", "file_id", ur.path_shape(F.col("path")).alias("shape"))


@query("b6_templates", "SELECT family, len(list_filter(string_split(family, '/'), lambda s: s <> '')) AS arity, len(list_filter(string_split(family, '/'), lambda s: s = '{param}')) AS params, count(*) AS n FROM shop_urls GROUP BY family")
def _(spark, sf):
    t = F.col("family")
    return table(spark, sf, "shop_urls").groupBy("family").agg(F.count("*").alias("n")).select("family", ur.template_arity(t).alias("arity"), ur.template_param_count(t).alias("params"), "n")


@query("b7_status_class", "SELECT CASE WHEN http_status IS NULL THEN 'error' WHEN http_status < 300 THEN 'ok' WHEN http_status < 400 THEN 'redirect' WHEN http_status < 500 THEN 'client_error' ELSE 'server_error' END AS class, count(*) AS n FROM observation GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "observation").groupBy(st.status_class(F.col("http_status")).alias("class")).agg(F.count("*").alias("n"))


OUTCOME = "CASE WHEN response_ms > 900 THEN 'blocked' WHEN http_status IS NULL THEN 'unknown' WHEN http_status IN (429, 403) THEN 'blocked' WHEN http_status = 410 THEN 'gone' WHEN http_status = 404 THEN 'not_found' WHEN http_status >= 500 THEN 'server_error' WHEN http_status BETWEEN 300 AND 399 THEN CASE WHEN observation_id % 2 + 1 > 1 THEN 'redirect_chain' ELSE 'redirect_single' END WHEN is_soft_404 THEN 'soft_not_found' ELSE 'ok' END"


@query("b8_outcome", f"SELECT c AS severity_class, CASE c WHEN 'gone' THEN 1.0 WHEN 'not_found' THEN 1.0 WHEN 'soft_not_found' THEN 0.9 WHEN 'server_error' THEN 0.8 WHEN 'redirect_chain' THEN 0.4 WHEN 'redirect_single' THEN 0.15 ELSE 0.0 END::DOUBLE AS weight, c IN ('blocked', 'unknown') AS absence, count(*) AS n FROM (SELECT {OUTCOME} AS c FROM observation) GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "observation")
    c = st.classify_outcome(F.col("http_status"), F.col("is_soft_404"), F.col("observation_id") % 2 + 1, F.col("response_ms") > 900)
    s = F.col("severity_class")
    return o.select(c.alias("severity_class")).groupBy("severity_class").agg(F.count("*").alias("n")).select(s, st.severity_weight(s, st.SEVERITY_WEIGHTS).alias("weight"), st.is_absence_of_evidence(s).alias("absence"), "n")


ERRORS = "CASE event_id % 7 WHEN 0 THEN 'Connect ETIMEDOUT' WHEN 1 THEN 'getaddrinfo ENOTFOUND x' WHEN 2 THEN 'ECONNREFUSED 1' WHEN 3 THEN 'bad certificate' WHEN 4 THEN 'AbortError' WHEN 5 THEN 'EAI_AGAIN' ELSE event_type END"


@query("b11_errors", f"SELECT CASE WHEN m LIKE '%timeout%' OR m LIKE '%etimedout%' THEN 'timeout' WHEN m LIKE '%enotfound%' OR m LIKE '%eai_again%' THEN 'dns' WHEN m LIKE '%econnrefused%' THEN 'connection_refused' WHEN m LIKE '%cert%' OR m LIKE '%tls%' OR m LIKE '%ssl%' THEN 'tls' WHEN m LIKE '%abort%' THEN 'aborted' ELSE 'unknown' END AS reason, count(*) AS n FROM (SELECT lower({ERRORS}) AS m FROM events) GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(st.classify_error(F.expr(ERRORS)).alias("reason")).agg(F.count("*").alias("n"))


SIGNALS = " ".join(f"WHEN {'regexp_matches(h, ' + chr(39) + '(^|[^0-9a-z])404([^0-9a-z]|$)' + chr(39) + ')' if s == '404' else 'contains(h, ' + chr(39) + s + chr(39) + ')'} THEN '{s}'" for s in st.SOFT404_SIGNALS)


@query("b12_soft404", f"SELECT page_id, coalesce(signal IS NOT NULL, false) OR strlen(html) < 1000 AS is_soft404, signal AS matched_signal, strlen(html) < 1000 AS is_short_body FROM (SELECT page_id, html, CASE {SIGNALS} END AS signal FROM (SELECT page_id, html, lower(html) AS h FROM pages))")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", st.detect_soft404(F.col("html")).alias("v")).select("page_id", "v.*")


REASONS = "CASE WHEN status = 'failed' THEN CASE total_patterns WHEN 0 THEN 'STAGE_EXHAUSTED_RETRIES:INGEST:open EACCES x' WHEN 1 THEN 'STAGE_EXHAUSTED_RETRIES:VERIFY:ECONNRESET' WHEN 2 THEN 'STAGE_EXHAUSTED_RETRIES:ESTIMATE:boom' ELSE 'lost worker' END END"


@query("b13_run_failures", f"SELECT nullif(regexp_extract(reason, '^STAGE_EXHAUSTED_RETRIES:([A-Z]+):', 1), '') AS stage, CASE WHEN reason LIKE 'STAGE%EACCES%' THEN 'local storage is not writable' WHEN reason LIKE 'STAGE%ECONNRESET%' THEN 'the server reset the connection' END AS cause, count(*) AS n FROM (SELECT {REASONS} AS reason FROM sitemap_run) WHERE reason IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    r = table(spark, sf, "sitemap_run").select(F.expr(REASONS).alias("reason")).where("reason is not null")
    return r.select(st.run_failure_reason(F.col("reason")).alias("v")).groupBy("v.stage", "v.cause").agg(F.count("*").alias("n"))


@query("b15_rate_limit_key", "SELECT rate_key, count(*) AS n FROM (SELECT lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS rate_key FROM pages) GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "pages").groupBy(ur.rate_limit_key(F.col("url")).alias("rate_key")).agg(F.count("*").alias("n"))


@query("b17_coverage", "SELECT pattern_id, round(CASE WHEN population > 0 THEN sample_size / population::DOUBLE END, 8) AS coverage FROM sample")
def _(spark, sf):
    return table(spark, sf, "sample").select("pattern_id", F.round(st.coverage_fraction(F.col("sample_size"), F.col("population")), 8).alias("coverage"))


# filters

@query("c1_scope_org", "SELECT run_id, site_id, total_urls FROM sitemap_run WHERE site_id IN (SELECT site_id FROM site WHERE org_id = 'n7' AND is_active AND deleted_at IS NULL)")
def _(spark, sf):
    return reports.scope_org(table(spark, sf, "sitemap_run"), table(spark, sf, "site"), "n7").select("run_id", "site_id", "total_urls")


@query("c2_filter_sites", "SELECT site_id, tier FROM site WHERE deleted_at IS NULL AND tier = 'priority'")
def _(spark, sf):
    return reports.filter_sites(table(spark, sf, "site"), "priority", include_inactive=True).select("site_id", "tier")


@query("c3_filter_observations", "SELECT observation_id, http_status FROM observation WHERE http_status BETWEEN 400 AND 499")
def _(spark, sf):
    return reports.filter_observations(table(spark, sf, "observation"), "client_error").select("observation_id", "http_status")


@query("c4_filter_patterns", "SELECT pattern_id FROM pattern WHERE status = 'needs_review'")
def _(spark, sf):
    return reports.filter_patterns(table(spark, sf, "pattern"), "needs_review").select("pattern_id")


@query("c5_lookup", "SELECT pattern_id, template FROM pattern WHERE pattern_id IN (SELECT pattern_id FROM sample)")
def _(spark, sf):
    return reports.lookup(table(spark, sf, "pattern"), table(spark, sf, "sample"), "pattern_id").select("pattern_id", "template")


@query("c7_split_locs", f"SELECT file_id, CASE WHEN regexp_replace({HOST.format(x='loc')}, '^www\\.', '') LIKE '%.example.com' AND regexp_replace({HOST.format(x='loc')}, '^www\\.', '') = 'therha.example.com' THEN 'matched' ELSE 'foreign' END AS kind, count(*) AS n FROM locs GROUP BY 1, 2")
def _(spark, sf):
    return patterns.split_counts(patterns.split_locs(table(spark, sf, "locs"), "https://therha.example.com/", "www.therha.example.com"))


@query("c7_foreign_hosts", f"SELECT detected_host, count(*) AS n FROM (SELECT regexp_replace({HOST.format(x='loc')}, '^www\\.', '') AS detected_host FROM locs) WHERE detected_host <> 'therha.example.com' GROUP BY 1")
def _(spark, sf):
    return patterns.foreign_hosts(patterns.split_locs(table(spark, sf, "locs"), "https://therha.example.com/", "therha.example.com"))


@query("c8_derive_host", f"SELECT host FROM (SELECT regexp_replace({HOST.format(x='url')}, '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, host LIMIT 1")
def _(spark, sf):
    return patterns.derive_host(table(spark, sf, "pages"))


# joins

@query("d1_findings_with_pattern", "SELECT finding_id, template, point_estimate FROM finding JOIN pattern USING (site_id, pattern_id)")
def _(spark, sf):
    return reports.findings_with_pattern(findings(spark, sf), table(spark, sf, "pattern")).select("finding_id", "template", "point_estimate")


@query("d4_populations_with_file", "SELECT pattern_id, file_id, filename, p.url_count AS url_count FROM pattern_population p JOIN sitemap_file f USING (site_id, file_id)")
def _(spark, sf):
    return reports.populations_with_file(table(spark, sf, "pattern_population"), table(spark, sf, "sitemap_file").drop("url_count")).select("pattern_id", "file_id", "filename", "url_count")


RESOLVE = "CASE ordinal % 5 WHEN 0 THEN 'hash_mismatch' WHEN 1 THEN 'missing_ordinal' WHEN 2 THEN 'unknown_file' ELSE 'resolved' END"


@query("d5_resolve_candidates", f"SELECT CASE ordinal % 5 WHEN 2 THEN file_id + 1000 ELSE file_id END AS file_id, CASE ordinal % 5 WHEN 1 THEN -ordinal - 1 ELSE ordinal END AS ordinal, {RESOLVE} AS status, CASE WHEN ordinal % 5 IN (1, 2) THEN NULL ELSE {PATH.format(x='loc')} || regexp_extract(regexp_replace(loc, '#.*$', ''), '(\\?.+)$', 1) END AS path, (ordinal % 5 <> 2 AND min(CASE WHEN ordinal % 5 IN (0, 1) THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, ordinal % 5 = 2) = 1) AS file_ok FROM locs")
def _(spark, sf):
    kind = F.col("ordinal") % 5
    # what an earlier run had stored
    samples = upserts.checkpointed(parsed(spark, sf).select(
        F.when(kind == 2, F.col("file_id") + 1000).otherwise(F.col("file_id")).cast("int").alias("file_id"), F.when(kind == 1, -F.col("ordinal") - 1).otherwise(F.col("ordinal")).cast("int").alias("ordinal"),
        F.when(kind == 0, F.lit(-1)).otherwise(ur.stable_hash(F.col("path"))).alias("hash"),
    ))
    return patterns.resolve_candidates(samples, table(spark, sf, "locs"), "https://example.com/", _own_host(F.col("loc"))).select("file_id", "ordinal", "status", "path", "file_ok")


# patterns

TWO_LEVELS = f"""
    WITH u AS (SELECT file_id, loc, {SEGMENTS.format(x='loc')} AS s FROM locs), g AS (SELECT s[1] AS a, count(*) AS obs, count(DISTINCT s[2]) AS fan FROM u GROUP BY 1),
    t AS (SELECT u.file_id, '/' || u.s[1] || '/' || CASE WHEN g.fan > 100 OR (g.obs >= 30 AND g.fan / g.obs::DOUBLE >= 0.6) THEN '{{param}}' ELSE u.s[2] END AS template FROM u JOIN g ON u.s[1] = g.a)
    """


@query("e7_pattern_summary", f"SELECT * FROM ({TWO_LEVELS} SELECT template, 2 AS segment_count, count(*) AS population_count, count(DISTINCT file_id) AS file_count FROM t GROUP BY template)")
def _(spark, sf):
    p = parsed(spark, sf)
    return patterns.pattern_summary(patterns.assign_patterns(p, patterns.learn_patterns(p)))


@query("e8_pattern_population", f"SELECT * FROM ({TWO_LEVELS} SELECT template, file_id, count(*) AS url_count FROM t GROUP BY template, file_id)")
def _(spark, sf):
    p = parsed(spark, sf)
    return patterns.pattern_population(patterns.assign_patterns(p, patterns.learn_patterns(p)))


#: Whether so many children among so many URLs are values.
VARIES = "({f} > 100 OR ({o} >= 30 AND {f} / {o}::DOUBLE >= 0.6))"
#: The shop's patterns, level by level: order numbers, parts of each flag, sections beside the other first segments, and pages below them.
SHOP_PATTERNS = f"""SELECT * FROM (WITH e AS (SELECT file_id, string_split(path, '/') AS s FROM shop_urls), u AS (SELECT file_id, s[2] AS a, s[3] AS b, s[4] AS c, s[5] AS d FROM e),
    ord AS (SELECT count(DISTINCT b) AS f, count(*) AS o FROM u WHERE a = 'order'), part AS (SELECT b, count(DISTINCT c) AS f, count(*) AS o FROM u WHERE a = 'shop' GROUP BY b),
    root AS (SELECT count(DISTINCT a) AS f, count(*) AS o, count(DISTINCT a) FILTER (a LIKE 'section-%') AS alike FROM u), flat AS (SELECT {VARIES.format(f='f', o='o')} AND {VARIES.format(f='alike', o='o')} AS section_is_param FROM root),
    sec AS (SELECT CASE WHEN section_is_param THEN '{{param}}' ELSE a END AS a2, count(DISTINCT c) AS f, count(*) AS o FROM u, flat WHERE a LIKE 'section-%' GROUP BY 1),
    t AS (SELECT file_id, CASE a WHEN 'about' THEN '/about'
        WHEN 'order' THEN '/order/' || (SELECT CASE WHEN {VARIES.format(f='f', o='o')} THEN '{{param}}' ELSE u.b END FROM ord) || '/line/' || d
        WHEN 'shop' THEN '/shop/' || u.b || '/' || (SELECT CASE WHEN {VARIES.format(f='f', o='o')} THEN '{{param}}' ELSE u.c END FROM part WHERE part.b = u.b)
        ELSE '/' || a2 || '/page/' || CASE WHEN {VARIES.format(f='sec.f', o='sec.o')} THEN '{{param}}' ELSE c END END AS template
        FROM u, flat LEFT JOIN sec ON a2 = CASE WHEN section_is_param THEN '{{param}}' ELSE a END AND a LIKE 'section-%')
    SELECT template, len(string_split(template, '/')) - 1 AS segment_count, count(*) AS population_count, count(DISTINCT file_id) AS file_count FROM t GROUP BY 1)"""


@query("e1_learn_shop", SHOP_PATTERNS)
def learn_shop(spark, sf):
    """Patterns of every order line's URL, with exact populations."""
    u = table(spark, sf, "shop_urls").withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != ""))
    return patterns.pattern_summary(patterns.assign_patterns(u, patterns.learn_patterns(u)))


#: First segments that are customers: most have orders of one kind, some of both. What holds both looks like neither, but like what the others become together.
STRAGGLERS = """SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'help' ELSE 'c' || cast(o_custkey AS string) END AS a,
    CASE WHEN o_orderkey % 97 = 0 THEN 'contact' WHEN o_custkey % 20 = 0 AND o_orderkey % 2 = 0 THEN 'open' WHEN o_custkey % 20 = 0 THEN 'done' WHEN o_custkey % 2 = 1 THEN 'open' ELSE 'done' END AS b FROM {orders}"""


@query("e5_stragglers", f"""SELECT * FROM (WITH p AS ({STRAGGLERS.format(orders='orders')}), g AS (SELECT a, count(*) AS n, string_agg(DISTINCT b, '|' ORDER BY b) AS sig FROM p GROUP BY a),
    o AS (SELECT sum(n) AS obs FROM g), k AS (SELECT sig, count(*) AS alike FROM g GROUP BY sig), c AS (SELECT sig FROM k, o WHERE {VARIES.format(f='alike', o='obs')}),
    u AS (SELECT string_agg(DISTINCT b, '|' ORDER BY b) AS merged FROM (SELECT unnest(string_split(sig, '|')) AS b FROM c))
    SELECT '/' || CASE WHEN sig IN (SELECT sig FROM c) OR sig = (SELECT merged FROM u) THEN '{{param}}' ELSE a END || '/' || b AS template, count(*) AS n FROM p JOIN g USING (a) GROUP BY 1)""")
def _(spark, sf):
    """Names that join the parameter because they look like it, once it is there."""
    u = spark.sql(STRAGGLERS.format(orders=f"parquet.`{sf}/orders.parquet`")).select(F.array("a", "b").alias("segments"))
    return patterns.assign_patterns(u, patterns.learn_patterns(u)).groupBy("template").agg(F.count("*").alias("n"))


@query("e9_merge_passes", f"SELECT * FROM ({TWO_LEVELS} SELECT template, count(*) AS n FROM t GROUP BY template)")
def _(spark, sf):
    p = parsed(spark, sf)
    counts = [patterns.path_counts(p.where(c)) for c in ("file_id = 0", "file_id = 1", "file_id > 1")]
    rules = patterns.learn_from_counts(patterns.merge_pattern_passes(*counts))
    return patterns.assign_patterns(p, rules).groupBy("template").agg(F.count("*").alias("n"))


#: A page's path with its query, and its hash and template.
FULL_PATH = PATH.format(x="loc") + " || regexp_extract(regexp_replace(loc, '#.*$', ''), '(\\?.+)$', 1)"
PASS_ROWS = f"{TWO_LEVELS}, h AS (SELECT t.template, t.file_id, l.ordinal, {FNV.format(x=FULL_PATH)} AS hash FROM t JOIN locs l ON l.file_id = t.file_id AND l.ordinal = t.ordinal)".replace("SELECT file_id, loc,", "SELECT file_id, ordinal, loc,").replace("SELECT u.file_id, '/'", "SELECT u.file_id, u.ordinal, '/'")
#: Candidates of a template that the passes keep.
PASS_CAPACITY = 20


def merged_passes(spark: SparkSession, sf: str) -> passes.Pass:
    """Three passes over the pages' files, saved as tables, read again and merged; what came apart is counted again."""
    urls = upserts.checkpointed(parsed(spark, sf).select("segments", "path", "file_id", "ordinal"))
    folder, rules, found = upserts.shared_folder(spark, "passes"), None, []
    for k, own in enumerate(("file_id = 0", "file_id = 1", "file_id > 1")):
        made = passes.observe(urls.where(own), rules, PASS_CAPACITY)
        made.save(f"{folder}/{k}")
        rules = made.rules
        found.append(passes.load(spark, f"{folder}/{k}"))
    return passes.recount(passes.merge(*found), urls)


@query("e9_pass_state", f"SELECT template, segment_count, population_count, file_count, least(population_count, {PASS_CAPACITY}) AS sample_size, CASE WHEN population_count < {PASS_CAPACITY} THEN 4294967295 ELSE threshold END AS threshold, true AS exact FROM ({PASS_ROWS} SELECT template, 2 AS segment_count, count(*) AS population_count, count(DISTINCT file_id) AS file_count, max(hash) FILTER (r <= {PASS_CAPACITY}) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY hash, file_id, ordinal) AS r FROM h) GROUP BY 1)")
def _(spark, sf):
    return passes.summary(merged_passes(spark, sf))


@query("f8_expand_from_state", f"SELECT template, hash, file_id, ordinal FROM ({PASS_ROWS} SELECT *, row_number() OVER (PARTITION BY template ORDER BY hash, file_id, ordinal) AS r FROM h) WHERE r > 5 AND r <= 15")
def _(spark, sf):
    """The next ten candidates of each template, from merged passes; no URL is read again."""
    state = merged_passes(spark, sf)
    plan = state.sample.select("template").distinct().withColumn("k", F.lit(15))
    return sampling.expand_sample(sampling.k_smallest_sample(state.sample, ["template"], 5), state.sample, plan, ["template"]).select("template", "hash", "file_id", "ordinal")


@query("e10_parameterisation", "SELECT count(*) AS observed_urls, count(*) < 30 AS below_floor, greatest(0, 30 - count(*)) AS shortfall, count(DISTINCT family) AS templates, count(DISTINCT CASE WHEN family LIKE '%{param}%' THEN family END) AS parameterised, 100 AS unique_threshold, 0.6::DOUBLE AS ratio_threshold FROM shop_urls")
def _(spark, sf):
    return patterns.parameterisation_report(table(spark, sf, "shop_urls").withColumnRenamed("family", "template"))


@query("e11_group_by_shape", f"SELECT {SHAPE.format(x='path')} AS shape, count(*) AS n FROM shop_urls GROUP BY 1")
def _(spark, sf):
    return patterns.group_by_shape(table(spark, sf, "shop_urls"))


@query("e12_strata", f"SELECT family AS template, {SHAPE.format(x='path')} AS shape, count(*) AS population FROM shop_urls GROUP BY 1, 2")
def _(spark, sf):
    return patterns.stratify_by_shape(table(spark, sf, "shop_urls").withColumnRenamed("family", "template"))


# sampling

def candidates(spark, sf):
    return table(spark, sf, "shop_urls").select(F.col("family").alias("pattern_id"), "file_id", "ordinal", "path", ur.stable_hash(F.col("path")).alias("hash"))


@query("f1_k_smallest", f"SELECT pattern_id, file_id, ordinal, hash FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY hash, file_id, ordinal) AS r FROM (SELECT family AS pattern_id, file_id, ordinal, {FNV.format(x='path')} AS hash FROM shop_urls)) WHERE r <= 400")
def _(spark, sf):
    return sampling.k_smallest_sample(candidates(spark, sf).drop("path"), ["pattern_id"], 400)


@query("f2_threshold", f"SELECT pattern_id, CASE WHEN count(*) < 1200 THEN 4294967295 ELSE max(hash) END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY hash, file_id, ordinal) AS r FROM (SELECT family AS pattern_id, file_id, ordinal, {FNV.format(x='path')} AS hash FROM shop_urls)) WHERE r <= 1200 GROUP BY 1")
def _(spark, sf):
    return sampling.sample_threshold(sampling.k_smallest_sample(candidates(spark, sf), ["pattern_id"], 1200), ["pattern_id"])


SIZE = "CASE WHEN {p} <= 0 THEN 0 ELSE least({p}, greatest(least(30, {p}), least(400, cast(floor({p} * 0.01::DOUBLE + 0.5::DOUBLE) AS bigint)))) END"


@query("f3_first_round", f"SELECT pattern_id, {SIZE.format(p='population_count * 20')} AS size FROM pattern")
def _(spark, sf):
    return table(spark, sf, "pattern").select("pattern_id", sampling.first_round_size(F.col("population_count") * 20).alias("size"))


SHAPES = f"SELECT family AS template, {SHAPE.format(x='path')} AS stratum, count(*) AS population FROM shop_urls GROUP BY 1, 2"


@query("f5_plan_strata", f"SELECT * FROM (WITH fs AS ({SHAPES}), fb AS (SELECT *, {SIZE.format(p='total')} AS fbudget FROM (SELECT *, cast(sum(population) OVER (PARTITION BY template) AS bigint) AS total FROM fs)), {allocation('fb', 'template', 'stratum', 'population', 'fbudget', 30)} SELECT template, stratum, population, size, cast(sum(size) OVER (PARTITION BY template) AS double) / total AS effective_rate FROM sized)")
def _(spark, sf):
    strata = patterns.stratify_by_shape(table(spark, sf, "shop_urls").withColumnRenamed("family", "template")).withColumnRenamed("shape", "stratum")
    return sampling.plan_first_round(strata, ["template"])


@query("f6_draw_samples", f"SELECT pattern_id, n AS population_at_draw, {SIZE.format(p='n')} AS k_requested, {SIZE.format(p='n')} AS sample_size FROM (SELECT family AS pattern_id, count(*) AS n FROM shop_urls GROUP BY 1)")
def _(spark, sf):
    c = candidates(spark, sf)
    samples, _ = sampling.draw_samples(c.groupBy("pattern_id").agg(F.count("*").alias("population")), c, c.select("file_id").distinct())
    return samples.select("pattern_id", "population_at_draw", "k_requested", "sample_size")


def strata_of(spark, sf):
    """Recorded outcomes as strata: one for each hour's half of a sample."""
    o = table(spark, sf, "observation")
    part = F.when(F.col("observation_id") % 3 == 0, "a").otherwise("b")
    t = o.groupBy("pattern_id", part.alias("label")).agg(F.count("*").alias("sampled"), F.count_if(F.col("http_status") == 404).alias("hits"))
    return t.withColumn("population", F.col("sampled") * (F.length("pattern_id") * 40))


STRATA = "SELECT pattern_id, CASE WHEN observation_id % 3 = 0 THEN 'a' ELSE 'b' END AS label, count(*) AS sampled, count(*) FILTER (http_status = 404) AS hits, count(*) * (length(pattern_id) * 40) AS population FROM observation GROUP BY 1, 2"


@query("f7_plan_expansion", f"SELECT * FROM (WITH st AS ({STRATA}), {expansion('st', 'pattern_id')} SELECT * FROM ex)")
def _(spark, sf):
    return estimate.plan_expansion(strata_of(spark, sf), ["pattern_id"]).drop("strata")


@query("f8_expand_sample", f"SELECT pattern_id, count(*) AS added FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY hash, file_id, ordinal) AS r FROM (SELECT family AS pattern_id, file_id, ordinal, {FNV.format(x='path')} AS hash FROM shop_urls)) WHERE r > 100 AND r <= 300 GROUP BY 1")
def _(spark, sf):
    c = candidates(spark, sf)
    plan = c.select("pattern_id").distinct().withColumn("k", F.lit(300))
    return sampling.expand_sample(sampling.k_smallest_sample(c, ["pattern_id"], 100), c, plan, ["pattern_id"]).groupBy("pattern_id").agg(F.count("*").alias("added"))


@query("f9_probe_budget", "SELECT cast(sum(sample_size) AS bigint) AS probes, sum(sample_size) / 5.0::DOUBLE AS seconds, sum(sample_size) > 5000 AS over_limit FROM sample")
def _(spark, sf):
    return sampling.probe_budget(table(spark, sf, "sample"), 5.0, 5000)


@query("f10_file_spread", "SELECT * FROM (WITH per AS (SELECT pattern_id, count(DISTINCT file_id) AS files FROM pattern_population GROUP BY 1), l AS (SELECT list_sort(list(files)) AS v, count(*) AS n, min(files) AS a, max(files) AS b, avg(files) AS m FROM per) SELECT a AS min_files, v[least(n - 1, cast(floor(n * 0.5) AS bigint)) + 1] AS p50_files, v[least(n - 1, cast(floor(n * 0.95) AS bigint)) + 1] AS p95_files, b AS max_files, round(m, 6) AS mean_files FROM l)")
def _(spark, sf):
    return sampling.candidate_file_spread(table(spark, sf, "pattern_population")).withColumn("mean_files", F.round("mean_files", 6))


# probe logs

@query("g2_escalation_audit", "SELECT seq, escalated_before, greatest(0, 4 - escalated_before) AS remaining, CASE WHEN escalated_before < 4 THEN 'allow' ELSE 'suppress' END AS decision FROM (SELECT seq, cast(coalesce(sum(cast(escalated AS int)) OVER (PARTITION BY pattern_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS escalated_before FROM probe)")
def _(spark, sf):
    return probes.escalation_audit(table(spark, sf, "probe")).select("seq", "escalated_before", "remaining", "decision")


@query("g2_escalation_summary", "SELECT pattern_id, count(*) AS probed, count(*) FILTER (escalated) AS escalated, round(count(*) FILTER (escalated) / count(*)::DOUBLE, 8) AS escalation_rate, count(*) + count(*) FILTER (escalated) AS request_cost FROM probe GROUP BY 1")
def _(spark, sf):
    return probes.escalation_summary(table(spark, sf, "probe")).withColumn("escalation_rate", F.round("escalation_rate", 8))


@query("g3_pattern_verdict", f"SELECT * FROM ({VERDICTS})")
def _(spark, sf):
    return probes.pattern_verdict(table(spark, sf, "probe"))


@query("g4_refusal_runs", "SELECT seq, in_a_row FROM (SELECT seq, CASE WHEN status IN (429, 403) THEN row_number() OVER (PARTITION BY host, island ORDER BY seq) ELSE 0 END AS in_a_row FROM (SELECT *, sum(change) OVER (PARTITION BY host ORDER BY seq) AS island FROM (SELECT *, CASE WHEN (CASE WHEN status IN (429, 403) THEN status ELSE 0 END) <> coalesce(lag(CASE WHEN status IN (429, 403) THEN status ELSE 0 END) OVER (PARTITION BY host ORDER BY seq), 0) THEN 1 ELSE 0 END AS change FROM probe)))")
def _(spark, sf):
    return probes.refusal_runs(table(spark, sf, "probe")).select("seq", F.col("in_a_row").cast("long").alias("in_a_row"))


@query("g4_refusal_circuits", f"SELECT * FROM ({CIRCUITS})")
def _(spark, sf):
    return probes.refusal_circuits(table(spark, sf, "probe").withColumn("at", F.col("seq") * 30.0))


@query("g5_probe_requests", "SELECT site_id, count(*) AS probes, count(*) FILTER (escalated_to_get) AS get_escalations, count(*) + count(*) FILTER (escalated_to_get) AS http_requests, count(*) FILTER (http_status IS NULL) AS no_response FROM observation GROUP BY 1")
def _(spark, sf):
    return probes.probe_requests(table(spark, sf, "observation"), "site_id")


# estimates

@query("h1_wilson", "SELECT pattern_id, http_status, is_soft_404, round(p, 10) AS point, round(low, 10) AS low, round(high, 10) AS high FROM interval3")
def _(spark, sf):
    t = reports.tally_observations(table(spark, sf, "observation"))
    s = table(spark, sf, "sample").select("pattern_id", "sample_id", "population", "sample_size")
    t = t.where("http_status is not null").join(s, "sample_id").withColumn("w", estimate.wilson_interval(F.col("n"), F.col("sample_size"), F.col("population")))
    return t.select("pattern_id", "http_status", "is_soft_404", *(F.round(f"w.{c}", 10).alias(c) for c in ("point", "low", "high")))


@query("h4_measure_strata", f"SELECT * FROM (WITH st AS ({STRATA}), {measured('st', 'pattern_id')} SELECT * FROM me)")
def _(spark, sf):
    return estimate.measure_proportion(strata_of(spark, sf), ["pattern_id"]).drop("strata", "unsampled_strata")


FINDING = "site_id, pattern_id, finding_id, observed_count, sample_size, population_count, point_estimate, ci_low, ci_high, evidence_tier, confidence_band, severity_class, severity_weight, round(impact_score, 6) AS impact_score"


@query("h9_findings", f"SELECT {FINDING} FROM finding")
def _(spark, sf):
    return findings(spark, sf).selectExpr(*FINDING.replace("round(impact_score, 6)", "round(impact_score; 6)").split(", ")[:-1], "round(impact_score, 6) AS impact_score")


STRATIFIED = """SELECT * FROM (WITH os AS (SELECT *, CASE WHEN observation_id % 3 = 0 THEN 'a' ELSE 'b' END AS label FROM observation),
    pop AS (SELECT site_id, pattern_id, sample_id, label, count(*) AS sampled, count(*) * 20 AS population FROM os GROUP BY ALL),
    outc AS (SELECT DISTINCT sample_id, http_status, is_soft_404 FROM os WHERE http_status IS NOT NULL),
    hit AS (SELECT sample_id, label, http_status, is_soft_404, count(*) AS hits FROM os WHERE http_status IS NOT NULL GROUP BY ALL),
    st AS (SELECT pop.*, http_status, is_soft_404, coalesce(hits, 0) AS hits FROM pop JOIN outc USING (sample_id) LEFT JOIN hit USING (sample_id, label, http_status, is_soft_404)), """ + measured("st", "site_id, pattern_id, sample_id, http_status, is_soft_404") + """
    SELECT site_id, pattern_id, sample_id, http_status, is_soft_404, observed_count, sample_size, population_count, point_estimate, ci_low, ci_high, evidence_tier, confidence_band, round(point_estimate * w, 6) AS impact_score
    FROM (SELECT *, CASE WHEN http_status IN (429, 403) THEN 0.0 WHEN http_status IN (410, 404) THEN 1.0 WHEN http_status >= 500 THEN 0.8 WHEN http_status BETWEEN 300 AND 399 THEN 0.15 WHEN is_soft_404 THEN 0.9 ELSE 0.0 END::DOUBLE AS w FROM me))"""


@query("h10_findings_stratified", STRATIFIED)
def _(spark, sf):
    o = table(spark, sf, "observation").withColumn("shape", F.when(F.col("observation_id") % 3 == 0, "a").otherwise("b"))
    s = o.groupBy("site_id", "pattern_id", "sample_id", "shape").agg((F.count("*") * 20).alias("population"))
    columns = ["site_id", "pattern_id", "sample_id", "http_status", "is_soft_404", "observed_count", "sample_size", "population_count", "point_estimate", "ci_low", "ci_high", "evidence_tier", "confidence_band"]
    return estimate.build_findings(o, s, label="shape").select(*columns, F.round(F.col("impact_score").cast("double"), 6).alias("impact_score"))


@query("h7_pattern_impact", "SELECT site_id, pattern_id, round(coalesce(sum(impact_score) FILTER (severity_class NOT IN ('blocked', 'unknown')), 0), 4) AS total, coalesce(count(*) FILTER (severity_class NOT IN ('blocked', 'unknown')), 0) = 0 AS is_unmeasured, arg_min(severity_class, -impact_score) AS worst FROM (SELECT * FROM finding ORDER BY pattern_id, impact_score DESC, finding_id) GROUP BY 1, 2".replace(", arg_min(severity_class, -impact_score) AS worst", ""))
def _(spark, sf):
    return estimate.rank_by_impact(estimate.score_pattern_impact(findings(spark, sf))).select("site_id", "pattern_id", F.round("total", 4).alias("total"), "is_unmeasured")


ONE_STRATUM = "SELECT pattern_id AS id, 'all' AS label, population, sample_size AS sampled, cast(floor(sample_size / 4.0::DOUBLE) AS bigint) AS hits FROM sample"


@query("h11_what_if", f"SELECT * FROM (WITH st AS ({ONE_STRATUM}), {expansion('st', 'id')} SELECT me.*, should_expand, reason, additional_total, {SIZE.format(p='population_count')} AS first_round FROM me JOIN ex USING (id))")
def _(spark, sf):
    s = table(spark, sf, "sample").select(F.col("pattern_id").alias("id"), "population", F.col("sample_size").alias("sampled"), F.floor(F.col("sample_size") / 4).alias("hits"))
    return estimate.what_if_plan(s)


# tallies and roll-ups

@query("i1_tally", "SELECT sample_id, http_status, is_soft_404, count(*) AS n FROM observation GROUP BY ALL")
def _(spark, sf):
    return reports.tally_observations(table(spark, sf, "observation"))


@query("i2_tally_runs", "SELECT run_id, http_status, is_soft_404, count(*) AS n FROM observation JOIN pattern USING (site_id, pattern_id) GROUP BY ALL")
def _(spark, sf):
    return reports.tally_run_observations(table(spark, sf, "observation"), table(spark, sf, "pattern"))


@query("i3_count_observations", "SELECT sample_id, count(*) AS n FROM observation GROUP BY 1")
def _(spark, sf):
    return reports.count_by(table(spark, sf, "observation"), "sample_id")


@query("i4_patterns_by_depth", "SELECT segment_count, count(*) AS n, cast(sum(population_count) AS bigint) AS population FROM pattern GROUP BY 1")
def _(spark, sf):
    return reports.count_patterns_by_depth(table(spark, sf, "pattern"))


@query("i5_patterns_by_status", "SELECT status, count(*) AS n, cast(sum(population_count) AS bigint) AS population FROM pattern GROUP BY 1")
def _(spark, sf):
    return reports.count_patterns_by_status(table(spark, sf, "pattern"))


@query("i6_count_sites", "SELECT org_id, count(*) AS n FROM site GROUP BY 1")
def _(spark, sf):
    return reports.count_by(table(spark, sf, "site"), "org_id")


@query("i7_expanded", "SELECT count(DISTINCT CASE WHEN round > 1 THEN pattern_id END) AS expanded FROM sample")
def _(spark, sf):
    return reports.count_expanded_patterns(table(spark, sf, "sample"))


@query("i8_sum_population", "SELECT cast(coalesce(sum(url_count), 0) AS bigint) AS population FROM pattern_population")
def _(spark, sf):
    return reports.sum_pattern_population(table(spark, sf, "pattern_population"))


@query("i9_findings_by_severity", "SELECT site_id, severity_class, count(*) AS n FROM finding GROUP BY 1, 2")
def _(spark, sf):
    return reports.count_findings_by_severity(findings(spark, sf))


@query("i10_depth_buckets", "SELECT CASE d WHEN 6 THEN '6+' ELSE cast(d AS string) END AS bucket, coalesce(n, 0) AS n, cast(coalesce(p, 0) AS bigint) AS population FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS d) LEFT JOIN (SELECT least(segment_count, 6) AS d, count(*) AS n, sum(population_count) AS p FROM pattern WHERE segment_count >= 1 GROUP BY 1) USING (d)")
def _(spark, sf):
    return reports.depth_buckets(table(spark, sf, "pattern"))


@query("i11_average_depth", "SELECT round(sum(segment_count * population_count) / sum(population_count)::DOUBLE, 8) AS average_depth FROM pattern")
def _(spark, sf):
    return reports.average_depth(table(spark, sf, "pattern")).select(F.round("average_depth", 8).alias("average_depth"))


@query("i12_outcome_slices", "SELECT CASE WHEN http_status IS NULL THEN 'no response' WHEN is_soft_404 THEN http_status || ' soft 404' ELSE cast(http_status AS string) END AS label, count(*) AS n FROM observation GROUP BY 1")
def _(spark, sf):
    return reports.outcome_slices(reports.tally_observations(table(spark, sf, "observation")))


@query("i13_run_status", "SELECT status AS label, count(*) AS n FROM sitemap_run GROUP BY 1")
def _(spark, sf):
    return reports.run_status_slices(table(spark, sf, "sitemap_run"))


ROLL = """SELECT site_id, pattern_id, max(population_count) AS population_count, count(*) FILTER (m AND severity_class <> 'ok') AS finding_count,
    cast(coalesce(sum(point_estimate) FILTER (m AND severity_class <> 'ok'), 0) AS bigint) AS point_estimate, cast(coalesce(sum(ci_low) FILTER (m AND severity_class <> 'ok'), 0) AS bigint) AS ci_low,
    cast(least(coalesce(sum(ci_high) FILTER (m AND severity_class <> 'ok'), 0), max(population_count)) AS bigint) AS ci_high, round(coalesce(sum(impact_score) FILTER (m AND severity_class <> 'ok'), 0), 4) AS impact_score,
    CASE WHEN count(*) FILTER (m) = 0 THEN 'blocked' WHEN bool_and(evidence_tier = 'counted') FILTER (m) THEN 'counted' ELSE 'estimated' END AS evidence_tier,
    CASE WHEN count(*) FILTER (m) = 0 OR bool_or(confidence_band = 'low') FILTER (m) THEN 'low' WHEN bool_or(confidence_band = 'approximate') FILTER (m) THEN 'approximate' ELSE 'confident' END AS confidence_band
    FROM (SELECT *, severity_class NOT IN ('blocked', 'unknown') AS m FROM finding) GROUP BY 1, 2"""


@query("i14_roll_up", ROLL)
def _(spark, sf):
    return reports.roll_up_pattern_impact(findings(spark, sf)).withColumn("impact_score", F.round("impact_score", 4)).drop("impact_low", "impact_high")


@query("i15_impact_bounds", "SELECT finding_id, round(ci_low * severity_weight, 6) AS impact_low, round(ci_high * severity_weight, 6) AS impact_high FROM finding")
def _(spark, sf):
    f = reports.with_impact_bounds(findings(spark, sf))
    return f.select("finding_id", F.round("impact_low", 6).alias("impact_low"), F.round("impact_high", 6).alias("impact_high"))


@query("i16_severities", f"SELECT site_id, count(*) AS total, count(*) FILTER (severity_class IN {CRITICAL}) AS critical FROM finding GROUP BY 1")
def _(spark, sf):
    return reports.group_severities(findings(spark, sf)).select("site_id", "total", "critical")


def health(spark, sf):
    p, s = table(spark, sf, "pattern"), table(spark, sf, "sample")
    files = table(spark, sf, "sitemap_file").withColumn("parsed_at", F.lit("2024-01-01").cast("timestamp"))
    runs = p.select("site_id", "run_id").distinct()
    return reports.finalize_run(runs, p, findings(spark, sf), files, table(spark, sf, "observation"), s, F.lit("2024-02-01").cast("timestamp"))


HEALTH = """SELECT site_id, run_id, patterns_total, patterns_measured, coalesce(low, 0) AS low_confidence_patterns, coalesce(failed, 0) AS files_failed, coalesce(files, 0) AS files_total, coalesce(requests, 0) AS http_requests FROM
    (SELECT site_id, run_id, count(*) AS patterns_total, count(*) FILTER (status = 'measured') AS patterns_measured FROM pattern GROUP BY 1, 2)
    LEFT JOIN (SELECT site_id, run_id, count(DISTINCT pattern_id) AS low FROM finding JOIN pattern USING (site_id, pattern_id) WHERE confidence_band = 'low' GROUP BY 1, 2) USING (site_id, run_id)
    LEFT JOIN (SELECT site_id, run_id, count(*) AS files, count(*) FILTER (parse_status = 'failed') AS failed FROM sitemap_file GROUP BY 1, 2) USING (site_id, run_id)
    LEFT JOIN (SELECT site_id, run_id, count(*) + count(*) FILTER (escalated_to_get) AS requests FROM observation JOIN pattern USING (site_id, pattern_id) GROUP BY 1, 2) USING (site_id, run_id)"""


@query("i17_finalize_run", HEALTH)
def _(spark, sf):
    return health(spark, sf).select("site_id", "run_id", "patterns_total", "patterns_measured", "low_confidence_patterns", "files_failed", "files_total", "http_requests")


@query("i18_judge_run", f"SELECT site_id, run_id, CASE WHEN files_total > 0 AND files_failed = files_total THEN 'ALL_FILES_FAILED' WHEN patterns_total = 0 THEN 'NO_PATTERNS_FOUND' WHEN patterns_measured = 0 THEN 'NOTHING_MEASURED' WHEN low_confidence_patterns / patterns_total::DOUBLE > 0.25 THEN 'LOW_CONFIDENCE_MAJORITY' WHEN files_failed > 0 THEN 'SOME_FILES_FAILED' END AS status_reason FROM ({HEALTH})")
def _(spark, sf):
    return reports.judge_run(health(spark, sf)).select("site_id", "run_id", "status_reason")


@query("i19_run_completion", "SELECT run_id, total_patterns, terminal, terminal >= total_patterns AND total_patterns <> 0 AS is_complete FROM (SELECT site_id, run_id, count(*) AS total_patterns, count(*) FILTER (status IN ('measured', 'needs_review', 'blocked')) AS terminal FROM pattern GROUP BY 1, 2)")
def _(spark, sf):
    p = table(spark, sf, "pattern")
    return reports.run_completion(p, p.groupBy("site_id", "run_id").agg(F.count("*").alias("total_patterns"))).select("run_id", "total_patterns", "terminal", "is_complete")


@query("i20_ingest_summary", "SELECT site_id, run_id, files_parsed, files_failed, total_urls, coalesce(patterns, 0) AS patterns FROM (SELECT site_id, run_id, count(*) FILTER (parse_status = 'parsed') AS files_parsed, count(*) FILTER (parse_status = 'failed') AS files_failed, cast(sum(url_count) AS bigint) AS total_urls FROM sitemap_file GROUP BY 1, 2) LEFT JOIN (SELECT site_id, run_id, count(*) AS patterns FROM pattern GROUP BY 1, 2) USING (site_id, run_id)")
def _(spark, sf):
    return reports.ingest_summary(table(spark, sf, "sitemap_file"), table(spark, sf, "pattern"), table(spark, sf, "sample")).select("site_id", "run_id", "files_parsed", "files_failed", "total_urls", "patterns")


@query("i21_stale_runs", "SELECT run_id FROM sitemap_run WHERE status = 'running' AND started_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 15 MINUTE")
def _(spark, sf):
    r = table(spark, sf, "sitemap_run").withColumn("heartbeat_at", F.col("started_at"))
    return reports.stale_runs(r, F.lit("1998-01-01").cast("timestamp")).select("run_id")


# windows and rankings

@query("j1_latest_run", "SELECT site_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC NULLS LAST, created_at DESC, run_id DESC) AS r FROM sitemap_run) WHERE r = 1")
def _(spark, sf):
    return reports.latest_run_per_site(table(spark, sf, "sitemap_run")).select("site_id", "run_id", "status")


@query("j2_latest_sample", "SELECT site_id, pattern_id, CASE WHEN sample_id % 2 = 0 THEN sample_id + 1000000 ELSE sample_id END AS sample_id, CASE WHEN sample_id % 2 = 0 THEN 1 + sample_id % 2 + 1 ELSE 1 + sample_id % 2 END AS round FROM sample")
def _(spark, sf):
    """Every other sample has a second round."""
    s = table(spark, sf, "sample").select("site_id", "pattern_id", "sample_id", "round")
    second = s.where("sample_id % 2 = 0").withColumns({"sample_id": F.col("sample_id") + 1_000_000, "round": F.col("round") + 1})
    return reports.latest_sample_per_pattern(s.unionByName(second))


@query("j3_latest_complete", "SELECT site_id, run_id FROM (SELECT *, min(r) OVER (PARTITION BY site_id) AS f FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC NULLS LAST, run_id DESC) AS r FROM sitemap_run) WHERE r <= 10 AND status IN ('complete', 'degraded')) WHERE r = f")
def _(spark, sf):
    return reports.latest_complete_run(table(spark, sf, "sitemap_run")).select("site_id", "run_id")


@query("j4_run_trend", "SELECT run_id, previous_urls, round(CASE WHEN previous_urls <> 0 THEN (total_urls - previous_urls) / previous_urls::DOUBLE * 100 END, 6) AS trend_percent FROM (SELECT *, lag(total_urls) OVER (PARTITION BY site_id ORDER BY started_at, run_id) AS previous_urls FROM sitemap_run)")
def _(spark, sf):
    return reports.run_trend(table(spark, sf, "sitemap_run")).select("run_id", "previous_urls", F.round("trend_percent", 6).alias("trend_percent"))


@query("j5_worst_finding", "SELECT site_id, pattern_id, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, pattern_id ORDER BY impact_score DESC, finding_id) AS r FROM finding) WHERE r = 1")
def _(spark, sf):
    return reports.worst_finding(findings(spark, sf)).select("site_id", "pattern_id", "finding_id")


@query("j6_health_series", "SELECT site_id, day, http_requests, round(CASE WHEN prev <> 0 THEN (http_requests - prev) / prev::DOUBLE * 100 END, 6) AS change_percent FROM (SELECT *, lag(http_requests) OVER (PARTITION BY site_id ORDER BY day) AS prev, row_number() OVER (PARTITION BY site_id ORDER BY day DESC) AS r FROM (SELECT site_id, cast(date_trunc('day', observed_at) AS timestamp) AS day, count(*) AS http_requests FROM observation GROUP BY 1, 2)) WHERE r <= 12")
def _(spark, sf):
    h = table(spark, sf, "observation").groupBy("site_id", F.date_trunc("day", "observed_at").alias("window_start")).agg(F.count("*").alias("http_requests"))
    return reports.health_series(h, 12).select("site_id", F.col("window_start").alias("day"), "http_requests", F.round("change_percent", 6).alias("change_percent"))


@query("k1_patterns_ranked", "SELECT pattern_id, population_count, round(coalesce(i, 0), 4) AS impact, coalesce(c, 0) AS finding_count FROM pattern LEFT JOIN (SELECT site_id, pattern_id, sum(impact_score) AS i, count(*) AS c FROM finding GROUP BY 1, 2) USING (site_id, pattern_id)")
def _(spark, sf):
    return reports.list_patterns_ranked(table(spark, sf, "pattern"), findings(spark, sf), "impact").select("pattern_id", "population_count", F.round("impact", 4).alias("impact"), "finding_count")


@query("k2_top_findings", "SELECT finding_id, round(impact_score, 6) AS impact_score FROM finding ORDER BY finding.impact_score DESC NULLS LAST, finding_id LIMIT 100")
def _(spark, sf):
    return reports.list_findings_by_impact(findings(spark, sf)).select("finding_id", F.round("impact_score", 6).alias("impact_score"))


@query("k3_newest_observations", "SELECT observation_id, url FROM observation ORDER BY observed_at DESC, observation_id DESC LIMIT 50 OFFSET 20")
def _(spark, sf):
    return reports.list_run_observations(table(spark, sf, "observation"), 50, 20).select("observation_id", "url")


@query("k4_top_and_smallest", "SELECT site_id, pattern_id, CASE WHEN d <= 3 THEN cast(d AS string) ELSE 'smallest' END AS place FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY population_count DESC, pattern_id) AS d, row_number() OVER (PARTITION BY site_id ORDER BY population_count, pattern_id) AS u FROM pattern) WHERE d <= 3 OR u = 1")
def _(spark, sf):
    return reports.top_and_smallest(table(spark, sf, "pattern")).select("site_id", "pattern_id", "place")


@query("k5_pattern_explorer", f"SELECT pattern_id, status, coalesce(round(impact_score, 4), -1) AS impact_score, worst FROM pattern LEFT JOIN (SELECT site_id, pattern_id, impact_score FROM ({ROLL})) USING (site_id, pattern_id) LEFT JOIN (SELECT site_id, pattern_id, severity_class AS worst FROM (SELECT *, row_number() OVER (PARTITION BY site_id, pattern_id ORDER BY impact_score DESC, finding_id) AS r FROM finding) WHERE r = 1) USING (site_id, pattern_id)")
def _(spark, sf):
    e = reports.pattern_explorer(table(spark, sf, "pattern"), findings(spark, sf), table(spark, sf, "observation"))
    return e.select("pattern_id", "status", F.coalesce(F.round("impact_score", 4), F.lit(-1.0)).alias("impact_score"), F.col("worst_severity").alias("worst"))


@query("k6_portfolio", "SELECT site_id, tier, run_id, CASE WHEN status IS NULL THEN 'never_run' WHEN status IN ('pending', 'running') THEN 'in_flight' WHEN total_urls = 0 THEN 'no_urls' ELSE 'measured' END AS state FROM site LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC NULLS LAST, created_at DESC, run_id DESC) AS r FROM sitemap_run) WHERE r = 1) USING (site_id) WHERE is_active AND deleted_at IS NULL")
def _(spark, sf):
    return reports.portfolio(table(spark, sf, "site"), table(spark, sf, "sitemap_run"), findings(spark, sf)).select("site_id", "tier", "run_id", "state")


@query("k7_run_report", """SELECT r.site_id, r.run_id, total_urls, previous_urls, round(CASE WHEN previous_urls <> 0 THEN (total_urls - previous_urls) / previous_urls::DOUBLE * 100 END, 6) AS trend_percent, coalesce(n, 0) AS files, coalesce(bad, 0) AS files_failed, coalesce(own, 0) AS patterns, round(depth, 6) AS average_depth, coalesce(n, 0) AS observations, coalesce(silent, 0) AS no_response
    FROM (SELECT *, lag(total_urls) OVER (PARTITION BY site_id ORDER BY started_at, run_id) AS previous_urls FROM sitemap_run) r
    LEFT JOIN (SELECT 'o' || l_orderkey AS run_id, count(*) AS n, count(DISTINCT l_linenumber) AS own, count(*) FILTER (l_returnflag = 'R') AS bad, sum(l_linenumber * l_quantity) / sum(l_quantity) AS depth, count(*) FILTER (l_linestatus = 'O') AS silent FROM lineitem GROUP BY 1) l USING (run_id)""")
def _(spark, sf):
    """Every run's report; an order is a run, and its lines are files, patterns and observations."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("site_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("run_id"), F.format_string("%d-%d", "l_orderkey", "l_linenumber").alias("pattern_id"), F.lit("/").alias("template"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("parsed").alias("parse_status"), F.col("l_linenumber").alias("segment_count"), F.col("l_quantity").alias("population_count"), F.when(F.col("l_linestatus") != "O", 200).alias("http_status"),
    )
    made = reports.run_report(table(spark, sf, "sitemap_run"), lines.select("site_id", "run_id", "parse_status"), lines.groupBy("site_id", "run_id", "pattern_id", "template", "segment_count").agg(F.sum("population_count").alias("population_count")), lines.select("site_id", "pattern_id", "http_status"))
    return made.select("site_id", "run_id", "total_urls", "previous_urls", F.round("trend_percent", 6).alias("trend_percent"), "files", "files_failed", "patterns", F.round("average_depth", 6).alias("average_depth"), "observations", "no_response")


@query("k8_site_analytics", "SELECT 'window' AS part, site_id || ' ' || cast(cast(day AS date) AS string) AS label, http_requests AS n FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY day DESC) AS r FROM (SELECT site_id, date_trunc('day', observed_at) AS day, count(*) AS http_requests FROM observation GROUP BY 1, 2)) WHERE r <= 20 UNION ALL SELECT 'run', status, count(*) FROM sitemap_run GROUP BY 2 UNION ALL SELECT 'pattern', status, count(*) FROM pattern GROUP BY 2")
def _(spark, sf):
    """All three parts: windows of every site, runs by status, patterns by status."""
    h = table(spark, sf, "observation").groupBy("site_id", F.date_trunc("day", "observed_at").alias("window_start")).agg(F.count("*").alias("http_requests"))
    windows, runs, statuses = reports.site_analytics(table(spark, sf, "sitemap_run"), h, table(spark, sf, "pattern"), 20)
    windows = windows.select(F.lit("window").alias("part"), F.concat_ws(" ", "site_id", F.to_date("window_start").cast("string")).alias("label"), F.col("http_requests").alias("n"))
    return windows.unionByName(runs.select(F.lit("run").alias("part"), "label", "n")).unionByName(statuses.select(F.lit("pattern").alias("part"), F.col("status").alias("label"), "n"))


def pages_of_patterns(spark, sf):
    f = findings(spark, sf).withColumn("computed_at", F.lit("2024-01-01").cast("timestamp"))
    return reports.pattern_details(f, table(spark, sf, "observation"), table(spark, sf, "pattern_population"), table(spark, sf, "sitemap_file").drop("url_count"))


@query("k9_pattern_files", "SELECT site_id, pattern_id, file_id, filename, p.url_count AS url_count FROM pattern_population p JOIN sitemap_file f USING (site_id, file_id)")
def _(spark, sf):
    return pages_of_patterns(spark, sf)["files"].select("site_id", "pattern_id", "file_id", "filename", "url_count")


@query("k9_pattern_observations", "SELECT site_id, pattern_id, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, pattern_id ORDER BY observed_at DESC, observation_id DESC) AS r FROM observation) WHERE r <= 200")
def _(spark, sf):
    return pages_of_patterns(spark, sf)["observations"].select("site_id", "pattern_id", "observation_id")


@query("k9_pattern_findings", "SELECT f.site_id, f.pattern_id, finding_id, population FROM (SELECT *, row_number() OVER (PARTITION BY site_id, pattern_id ORDER BY finding_id) AS r FROM finding) f JOIN (SELECT site_id, pattern_id, cast(sum(url_count) AS bigint) AS population FROM pattern_population GROUP BY 1, 2) p USING (site_id, pattern_id) WHERE r <= 20")
def _(spark, sf):
    """Each pattern's newest findings beside its population."""
    pages = pages_of_patterns(spark, sf)
    return pages["findings"].join(pages["population"], ["site_id", "pattern_id"]).select("site_id", "pattern_id", "finding_id", "population")


@query("k10_list_runs", "SELECT run_id, status FROM sitemap_run ORDER BY started_at DESC NULLS LAST, run_id DESC LIMIT 100")
def _(spark, sf):
    return reports.list_runs(table(spark, sf, "sitemap_run"), 100).select("run_id", "status")


@query("k11_fleet_stats", f"SELECT * FROM (SELECT count(*) AS findings, count(DISTINCT site_id) AS sites_affected, count(*) FILTER (severity_class IN {CRITICAL}) AS critical, count(*) FILTER (severity_class IN ('blocked', 'unknown')) AS no_measurement FROM finding), (SELECT count(*) FILTER (status IN ('pending', 'running')) AS in_flight, count(*) FILTER (status IN ('degraded', 'failed')) AS degraded_or_failed, cast(sum(total_urls) AS bigint) AS total_urls FROM sitemap_run)")
def _(spark, sf):
    return reports.fleet_stats(findings(spark, sf), table(spark, sf, "sitemap_run"))


# upserts and checks

@query("l4_distinct_children", "SELECT url, count(*) AS n FROM (SELECT DISTINCT url FROM observation) GROUP BY 1")
def _(spark, sf):
    return upserts.distinct_children(table(spark, sf, "observation")).groupBy("url").agg(F.count("*").alias("n"))


@query("l1_append_new", "SELECT min(observation_id) AS observation_id, sample_id, url FROM observation WHERE observation_id % 3 <> 0 AND (sample_id, url) NOT IN (SELECT (sample_id, url) FROM observation WHERE observation_id % 3 = 0) GROUP BY sample_id, url")
def _(spark, sf):
    o = table(spark, sf, "observation").select("observation_id", "sample_id", "url")
    return upserts.append_new(o.where("observation_id % 3 <> 0"), o.where("observation_id % 3 = 0"), ["sample_id", "url"], "observation_id")


@query("l2_upsert_add", "SELECT pattern_id, cast(sum(url_count) AS bigint) AS url_count FROM pattern_population GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "pattern_population").groupBy("pattern_id", (F.col("file_id") % 2).alias("half")).agg(F.sum("url_count").alias("url_count"))
    return upserts.upsert_add(p.where("half = 0"), p.where("half = 1"), ["pattern_id"], ["url_count"])


@query("l3_upsert_replace", "SELECT pattern_id, file_id, CASE WHEN file_id % 3 = 0 THEN url_count * 10 ELSE url_count END AS url_count FROM pattern_population")
def _(spark, sf):
    # what an earlier run had stored, in parts that are small to sort
    with upserts.small_partitions(spark):
        p = upserts.checkpointed(table(spark, sf, "pattern_population").select("pattern_id", "file_id", "url_count"))
    return upserts.upsert_replace(p, p.where("file_id % 3 = 0").withColumn("url_count", F.col("url_count") * 10), ["pattern_id", "file_id"])


#: Each rule of findings is broken in every eighth sample; the rest stay as they are.
BROKEN = {
    "observed_count": "CASE sample_id % 8 WHEN 0 THEN sample_size + 1 ELSE observed_count END", "ci_low": "CASE sample_id % 8 WHEN 2 THEN point_estimate ELSE ci_low END",
    "ci_high": "CASE sample_id % 8 WHEN 1 THEN population_count + 1 WHEN 2 THEN point_estimate ELSE ci_high END", "evidence_tier": "CASE WHEN sample_id % 8 <> 3 THEN evidence_tier WHEN evidence_tier = 'counted' THEN 'estimated' ELSE 'counted' END",
    "impact_score": "CASE sample_id % 8 WHEN 4 THEN point_estimate + 1 ELSE impact_score END", "severity_class": "CASE sample_id % 8 WHEN 5 THEN 'ok' ELSE severity_class END",
}
BROKEN_FINDINGS = "SELECT finding_id, sample_id, sample_size, population_count, point_estimate, severity_weight, " + ", ".join(f"{sql} AS {c}" for c, sql in BROKEN.items()) + " FROM finding"
RULES_BROKEN = {
    "counts_sane": "observed_count > sample_size", "interval_ordered": "ci_low > point_estimate OR point_estimate > ci_high OR ci_high > population_count", "interval_not_degenerate": "sample_size < population_count AND ci_low = ci_high",
    "tier_matches_coverage": "(evidence_tier = 'counted') <> (sample_size >= population_count)", "impact_in_range": "impact_score > point_estimate", "no_impact_without_harm": "severity_class IN ('blocked', 'unknown', 'ok') AND (impact_score <> 0 OR severity_weight <> 0)",
}


@query("q1_finding_rules", " UNION ALL ".join(f"SELECT finding_id, '{rule}' AS rule FROM ({BROKEN_FINDINGS}) WHERE {sql}" for rule, sql in RULES_BROKEN.items()))
def _(spark, sf):
    f = findings(spark, sf).withColumns({"impact_score": F.col("impact_score").cast("double"), "severity_weight": F.col("severity_weight").cast("double")})
    return checks.violations(f.withColumns({c: F.expr(sql) for c, sql in BROKEN.items()}), checks.finding_rules(), ["finding_id"])


@query("q5_orphans", "SELECT site_id, pattern_id, 'population_of_pattern' AS rule FROM (SELECT CASE file_id % 7 WHEN 0 THEN 's' || cast((cast(substr(site_id, 2) AS int) + 1) % 5 AS string) ELSE site_id END AS site_id, pattern_id FROM pattern_population) c WHERE NOT EXISTS (SELECT 1 FROM pattern p WHERE p.status = 'measured' AND p.site_id = c.site_id AND p.pattern_id = c.pattern_id)")
def _(spark, sf):
    """Populations of patterns that aren't measured, or, for every seventh file, that another site has."""
    next_site = F.concat(F.lit("s"), ((F.substring("site_id", 2, 9).cast("int") + 1) % 5).cast("string"))
    child = table(spark, sf, "pattern_population").withColumn("site_id", F.when(F.col("file_id") % 7 == 0, next_site).otherwise(F.col("site_id")))
    return checks.orphans(child, table(spark, sf, "pattern").where("status = 'measured'"), ["site_id", "pattern_id"], "population_of_pattern")


@query("q6_duplicates", "SELECT sample_id, url, count(*) AS n, 'sample_url' AS rule FROM observation GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return checks.duplicates(table(spark, sf, "observation"), ["sample_id", "url"], "sample_url")


@query("q6_active_runs", "SELECT site_id, count(*) AS n, 'one_active_run' AS rule FROM sitemap_run WHERE status IN ('pending', 'running') GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return checks.several_active_runs(table(spark, sf, "sitemap_run"))


#: By table: a key, what breaks each rule, and for which rows.
DOMAINS = {
    "pattern": ("pattern_id", {"population_not_negative": ("population_count", "-1", "segment_count = 2"), "status_domain": ("status", "'odd'", "segment_count = 3")}),
    "pattern_population": ("pattern_id", {"url_count_positive": ("url_count", "0", "file_id % 9 = 0")}),
    "pattern_sample": ("pattern_id", {"round_positive": ("round", "0", "sample_id % 5 = 0"), "sample_within_population": ("population_at_draw", "sample_size - 1", "sample_id % 3 = 0")}),
    "sampling_health": ("site_id", {"window_ordered": ("window_end", "window_start", "http_requests % 2 = 0")}),
    "sitemap_run": ("run_id", {"status_domain": ("status", "'odd'", "total_patterns = 4")}),
    "site": ("site_id", {"tier_domain": ("tier", "'odd'", "is_active")}),
}
DOMAIN_SOURCES = {
    "pattern_sample": "SELECT pattern_id, sample_id, round, sample_size, population AS population_at_draw FROM sample",
    "sampling_health": "SELECT site_id, date_trunc('day', observed_at) AS window_start, date_trunc('day', observed_at) + INTERVAL '1' DAY AS window_end, count(*) AS http_requests FROM observation GROUP BY 1, 2, 3",
}


@query("q7_domains", " UNION ALL ".join(f"SELECT '{name}' AS of_table, {key} AS key, '{rule}' AS rule FROM ({DOMAIN_SOURCES.get(name, f'SELECT * FROM {name}')}) WHERE {rows}" for name, (key, rules) in DOMAINS.items() for rule, (_, _, rows) in rules.items()))
def _(spark, sf):
    """Every rule of every table, each broken in some rows."""
    found, rules = None, checks.domain_rules()
    for name, (key, broken) in DOMAINS.items():
        source = {"pattern_sample": "sample", "sampling_health": "observation"}.get(name, name)
        rows = table(spark, sf, source)
        if name in DOMAIN_SOURCES:
            rows.createOrReplaceTempView(f"checked_{source}")
            rows = spark.sql(DOMAIN_SOURCES[name].replace(f"FROM {source}", f"FROM checked_{source}"))
        rows = rows.withColumns({column: F.when(F.expr(when), F.expr(value)).otherwise(F.col(column)) for column, value, when in broken.values()})
        one = checks.violations(rows, rules[name], [key]).select(F.lit(name).alias("of_table"), F.col(key).alias("key"), "rule")
        found = one if found is None else found.unionByName(one)
    return found


@query("q8_population_adds_up", "SELECT site_id, pattern_id, population_count, coalesce(s, 0) AS from_files, 'population_adds_up' AS rule FROM pattern LEFT JOIN (SELECT site_id, pattern_id, cast(sum(url_count) AS bigint) AS s FROM pattern_population GROUP BY 1, 2) USING (site_id, pattern_id) WHERE coalesce(s, 0) <> population_count")
def _(spark, sf):
    return checks.population_mismatch(table(spark, sf, "pattern"), table(spark, sf, "pattern_population"))


@query("m1_stream_observations", "SELECT site_id, sample_id, url, min(observation_id) AS observation_id FROM observation GROUP BY 1, 2, 3")
def _(spark, sf):
    """The observations through the idempotent stream into a table, read back."""
    from pathsieve.streaming.runs import run_observations

    return run_observations(spark, sf).select("site_id", "sample_id", "url", "observation_id")


@query("m2_stream_tallies", "SELECT site_id, sample_id, http_status, is_soft_404, count(*) AS n FROM observation GROUP BY ALL")
def _(spark, sf):
    """Running tallies of the stream, as its last micro-batches leave them."""
    from pathsieve.streaming.runs import run_findings

    return run_findings(spark, sf)[0]


@query("m2_stream_findings", f"SELECT {FINDING} FROM finding")
def _(spark, sf):
    """Findings refreshed with every micro-batch, as the last ones leave them."""
    from pathsieve.streaming.runs import run_findings

    f = run_findings(spark, sf)[1].withColumn("finding_id", F.concat_ws(":", "pattern_id", F.col("http_status").cast("string"), F.col("is_soft_404").cast("string")))
    return f.selectExpr(*FINDING.replace("round(impact_score, 6)", "round(impact_score; 6)").split(", ")[:-1], "round(impact_score, 6) AS impact_score")


@query("m4_stream_stale_runs", "SELECT run_id, stale_ms FROM (SELECT 'r' || user_id AS run_id, epoch_us(max(ts)) // 1000 + 900000 AS stale_ms, (SELECT epoch_us(max(ts)) // 1000 FROM events) - 60000 AS reached FROM events GROUP BY 1) WHERE stale_ms <= reached")
def _(spark, sf):
    """Users of the log as runs; those silent for 15 minutes when the log ends."""
    from pathsieve.streaming.runs import run_stale

    return run_stale(spark, sf)


@query("m3_stream_circuits", f"SELECT * FROM ({CIRCUITS})")
def _(spark, sf):
    """The same openings as ``g4_refusal_circuits``, from the stream."""
    from pathsieve.streaming.runs import run_circuits

    return run_circuits(spark, sf)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
