"""Tallies, rankings, roll-ups and trends over patterns, samples, findings, runs and sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathsieve.functions.status import CRITICAL, is_absence_of_evidence, project_run_state, status_class, trend_percent
from pathsieve.operators.estimate import BANDS

#: Share of low-precision patterns above which a run is degraded (fixed value).
LOW_SHARE = 0.25
TERMINAL = ("measured", "needs_review", "blocked")


# scopes and filters

def scope_site(df: DataFrame, site_id: str) -> DataFrame:
    return df.where(F.col("site_id") == site_id)


def live_sites(sites: DataFrame, org_id: str | None = None) -> DataFrame:
    live = sites.where("is_active and deleted_at is null")
    return live.where(F.col("org_id") == org_id) if org_id is not None else live


def scope_org(df: DataFrame, sites: DataFrame, org_id: str) -> DataFrame:
    return df.join(live_sites(sites, org_id).select("site_id"), "site_id", "left_semi")


def filter_sites(sites: DataFrame, tier: str | None = None, include_inactive: bool = False) -> DataFrame:
    out = sites.where("deleted_at is null") if include_inactive else live_sites(sites)
    return out.where(F.col("tier") == tier) if tier else out


def filter_observations(observations: DataFrame, kind: str) -> DataFrame:
    return observations.where(status_class(F.col("http_status")) == kind)


def filter_patterns(patterns: DataFrame, status: str) -> DataFrame:
    return patterns.where(F.col("status") == status)


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def by_id(df: DataFrame, **ids: str) -> DataFrame:
    """Point look-up: ``by_id(runs, site_id="s1", run_id="r1")``."""
    for column, value in ids.items():
        df = df.where(F.col(column) == value)
    return df


# joins

def findings_with_pattern(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    return findings.join(patterns.select("site_id", "pattern_id", "template", "segment_count"), ["site_id", "pattern_id"])


def observations_with_run(observations: DataFrame, patterns: DataFrame) -> DataFrame:
    return observations.join(patterns.select("site_id", "pattern_id", "run_id", "template"), ["site_id", "pattern_id"])


def populations_with_file(populations: DataFrame, files: DataFrame) -> DataFrame:
    return populations.join(files, ["site_id", "file_id"])


# aggregations

def tally_observations(observations: DataFrame) -> DataFrame:
    return observations.groupBy("sample_id", "http_status", "is_soft_404").agg(F.count("*").alias("n"))


def tally_run_observations(observations: DataFrame, patterns: DataFrame) -> DataFrame:
    joined = observations_with_run(observations, patterns)
    return joined.groupBy("run_id", "http_status", "is_soft_404").agg(F.count("*").alias("n")).orderBy("run_id", F.asc_nulls_last("http_status"), "is_soft_404")


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def count_patterns_by_depth(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("segment_count").agg(F.count("*").alias("n"), F.sum("population_count").alias("population"))


def count_patterns_by_status(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("status").agg(F.count("*").alias("n"), F.sum("population_count").alias("population"))


def count_expanded_patterns(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count_distinct(F.when(F.col("round") > 1, F.col("pattern_id"))).alias("expanded"))


def sum_pattern_population(populations: DataFrame) -> DataFrame:
    return populations.agg(F.coalesce(F.sum("url_count"), F.lit(0)).alias("population"))


def count_findings_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("site_id", "severity_class").agg(F.count("*").alias("n"))


def depth_buckets(patterns: DataFrame) -> DataFrame:
    """Depths 1 to 5 and 6+, empty ones too; depth 0 is in none."""
    own = patterns.where("segment_count >= 1").groupBy(F.least("segment_count", F.lit(6)).cast("int").alias("depth")).agg(F.count("*").alias("n"), F.sum("population_count").alias("population"))
    every = patterns.sparkSession.range(1, 7).select(F.col("id").cast("int").alias("depth"))
    return every.join(own, "depth", "left").select(
        F.when(F.col("depth") == 6, "6+").otherwise(F.col("depth").cast("string")).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("population", F.lit(0)).alias("population")
    )


def average_depth(patterns: DataFrame) -> DataFrame:
    return patterns.agg(F.try_divide(F.sum(F.col("segment_count") * F.col("population_count")), F.sum("population_count")).alias("average_depth"))


def outcome_label(status: Column, soft: Column) -> Column:
    return F.when(status.isNull(), "no response").when(soft, F.concat(status.cast("string"), F.lit(" soft 404"))).otherwise(status.cast("string"))


def outcome_slices(tallies: DataFrame) -> DataFrame:
    label = outcome_label(F.col("http_status"), F.coalesce("is_soft_404", F.lit(False)))
    return tallies.groupBy(label.alias("label")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label")


def run_status_slices(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.col("status").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def roll_up_pattern_impact(findings: DataFrame) -> DataFrame:
    """One row for each pattern with findings, from stored scores and weights.

    Findings that are evidence are summed where they are not ``ok``; the upper
    end never exceeds the population; the tier is counted only if all evidence
    is, and the band is the widest. A pattern without evidence is blocked.
    """
    f = findings.withColumns({"measured": ~is_absence_of_evidence(F.col("severity_class")), "rank": F.array_position(F.array(*map(F.lit, BANDS)), F.col("confidence_band"))})
    f = f.withColumn("counted", F.col("measured") & (F.col("severity_class") != "ok"))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("counted"), c)), F.lit(0))

    out = f.groupBy("site_id", "pattern_id").agg(
        F.max("population_count").alias("population_count"), F.count_if("measured").alias("_m"), F.count_if("counted").alias("finding_count"),
        total(F.col("point_estimate")).alias("point_estimate"), total(F.col("ci_low")).alias("ci_low"), total(F.col("ci_high")).alias("_high"),
        total(F.col("impact_score")).alias("impact_score"), total(F.col("ci_low") * F.col("severity_weight")).alias("impact_low"), total(F.col("ci_high") * F.col("severity_weight")).alias("impact_high"),
        F.bool_and(F.when(F.col("measured"), F.col("evidence_tier") == "counted")).alias("_counted"), F.min(F.when(F.col("measured"), F.col("rank"))).alias("_rank"),
    )
    none = F.col("_m") == 0
    return out.select(
        "site_id", "pattern_id", "population_count", "finding_count", "point_estimate", "ci_low", F.least("_high", "population_count").alias("ci_high"), "impact_score", "impact_low", "impact_high",
        F.when(none, "blocked").when(F.col("_counted"), "counted").otherwise("estimated").alias("evidence_tier"),
        F.when(none, "low").otherwise(F.get(F.array(*map(F.lit, BANDS)), F.coalesce("_rank", F.lit(1)).cast("int") - 1)).alias("confidence_band"),
    )


def with_impact_bounds(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"impact_low": F.col("ci_low") * F.col("severity_weight"), "impact_high": F.col("ci_high") * F.col("severity_weight")})


def group_severities(findings: DataFrame) -> DataFrame:
    """Per site: findings, critical ones, and (severity, n) from the most frequent."""
    counts = count_findings_by_severity(findings)
    return counts.groupBy("site_id").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("severity_class").isin(*CRITICAL), F.col("n"))), F.lit(0)).alias("critical"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "severity_class", "n"))), lambda x: F.struct(x["severity_class"].alias("severity_class"), x["n"].alias("n"))).alias("severities"),
    )


def finalize_run(runs: DataFrame, patterns: DataFrame, findings: DataFrame, files: DataFrame, observations: DataFrame, samples: DataFrame, now: Column) -> DataFrame:
    """One health row for each run: counts of patterns by status, low precision, failed files, requests, window."""
    key = ["site_id", "run_id"]
    of = patterns.select("site_id", "pattern_id", "run_id")
    p = patterns.groupBy(*key).agg(
        F.count("*").alias("patterns_total"), *(F.count_if(F.col("status") == s).alias(f"patterns_{s}") for s in TERMINAL), F.count_if(F.col("status").isin(*TERMINAL)).alias("samples_drawn"))
    low = findings.where("confidence_band = 'low'").join(of, ["site_id", "pattern_id"]).groupBy(*key).agg(F.count_distinct("pattern_id").alias("low_confidence_patterns"))
    failed = files.groupBy(*key).agg(F.count_if(F.col("parse_status") == "failed").alias("files_failed"), F.count("*").alias("files_total"), F.min("parsed_at").alias("window_start"))
    requests = observations.join(of, ["site_id", "pattern_id"]).groupBy(*key).agg((F.count("*") + F.count_if("escalated_to_get")).alias("http_requests"))
    expanded = samples.where("round > 1").join(of, ["site_id", "pattern_id"]).groupBy(*key).agg(F.count_distinct("pattern_id").alias("samples_expanded"))
    out = runs.select(*key)
    for part in (p, low, failed, requests, expanded):
        out = out.join(part, key, "left")
    counts = [c for c in out.columns if c not in (*key, "window_start")]
    return out.fillna(0, counts).withColumns({"window_start": F.coalesce("window_start", now), "window_end": now})


def judge_run(health: DataFrame) -> DataFrame:
    """Status and reason of each run from its health row; the first rule that holds decides."""
    reason = (
        F.when((F.col("files_total") > 0) & (F.col("files_failed") == F.col("files_total")), "ALL_FILES_FAILED").when(F.col("patterns_total") == 0, "NO_PATTERNS_FOUND")
        .when(F.col("patterns_measured") == 0, "NOTHING_MEASURED").when(F.col("low_confidence_patterns") / F.nullif("patterns_total", F.lit(0)) > LOW_SHARE, "LOW_CONFIDENCE_MAJORITY")
        .when(F.col("files_failed") > 0, "SOME_FILES_FAILED")
    )
    return health.withColumn("status_reason", reason).withColumn("status", F.when(F.col("status_reason").isNull(), "complete").when(F.col("status_reason") == "ALL_FILES_FAILED", "failed").otherwise("degraded"))


def run_completion(patterns: DataFrame, runs: DataFrame) -> DataFrame:
    done = patterns.groupBy("site_id", "run_id").agg(F.count_if(F.col("status").isin(*TERMINAL)).alias("terminal"))
    out = runs.select("site_id", "run_id", "total_patterns").join(done, ["site_id", "run_id"], "left").fillna(0, ["terminal"])
    return out.withColumn("is_complete", (F.col("total_patterns") != 0) & (F.col("terminal") >= F.col("total_patterns")))


def ingest_summary(files: DataFrame, patterns: DataFrame, samples: DataFrame) -> DataFrame:
    key = ["site_id", "run_id"]
    f = files.groupBy(*key).agg(F.count_if(F.col("parse_status") == "parsed").alias("files_parsed"), F.count_if(F.col("parse_status") == "failed").alias("files_failed"), F.coalesce(F.sum("url_count"), F.lit(0)).alias("total_urls"))
    p = patterns.groupBy(*key).agg(F.count("*").alias("patterns"))
    s = samples.join(patterns.select("site_id", "pattern_id", "run_id"), ["site_id", "pattern_id"]).groupBy(*key).agg(F.count("*").alias("samples"))
    return f.join(p, key, "left").join(s, key, "left").fillna(0, ["patterns", "samples"]).withColumn("all_files_failed", (F.col("files_failed") > 0) & (F.col("files_parsed") == 0))


def stale_runs(runs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    stale = runs.where((F.col("status") == "running") & (F.col("heartbeat_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))
    return stale.withColumn("status_reason", F.lit(f"STALE_HEARTBEAT: no heartbeat for {minutes} minutes"))


# windows

def latest_run_per_site(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("site_id").orderBy(F.desc_nulls_last("started_at"), F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def latest_sample_per_pattern(samples: DataFrame) -> DataFrame:
    order = Window.partitionBy("site_id", "pattern_id").orderBy(F.desc("round"), F.desc("sample_id"))
    return samples.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def latest_complete_run(runs: DataFrame, recent: int = 10) -> DataFrame:
    """Per site the newest complete or degraded run among its ``recent`` newest (the feature's own look-back)."""
    order = Window.partitionBy("site_id").orderBy(F.desc_nulls_last("started_at"), F.desc("run_id"))
    near = runs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= recent).where(F.col("status").isin("complete", "degraded"))
    return near.withColumn("_f", F.min("_r").over(Window.partitionBy("site_id"))).where("_r = _f").drop("_r", "_f")


def run_trend(runs: DataFrame) -> DataFrame:
    before = F.lag("total_urls").over(Window.partitionBy("site_id").orderBy("started_at", "run_id"))
    return runs.withColumn("previous_urls", before).withColumn("trend_percent", trend_percent(F.col("total_urls"), F.col("previous_urls")))


def worst_finding(findings: DataFrame, order: str = "finding_id") -> DataFrame:
    w = Window.partitionBy("site_id", "pattern_id").orderBy(F.desc("impact_score"), F.col(order))
    return findings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def health_series(health: DataFrame, windows: int) -> DataFrame:
    order = Window.partitionBy("site_id").orderBy("window_start")
    h = health.withColumn("previous", F.lag("http_requests").over(order)).withColumn("change_percent", trend_percent(F.col("http_requests"), F.col("previous")))
    newest = Window.partitionBy("site_id").orderBy(F.desc("window_start"))
    return h.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= windows).drop("_r")


# ranked reports; a limit is the page that was asked for

def list_patterns_ranked(patterns: DataFrame, findings: DataFrame, sort: str = "population", status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    if sort not in ("population", "impact"):
        raise ValueError("sort is population or impact")
    p = filter_patterns(patterns, status) if status else patterns
    sums = findings.groupBy("site_id", "pattern_id").agg(F.sum("impact_score").alias("impact"), F.count("*").alias("finding_count"))
    out = p.join(sums, ["site_id", "pattern_id"], "left").fillna(0, ["impact", "finding_count"])
    out = out.orderBy(F.desc("population_count" if sort == "population" else "impact"), "pattern_id").offset(offset)
    return out.limit(limit) if limit is not None else out


def list_findings_by_impact(findings: DataFrame, limit: int = 100) -> DataFrame:
    return findings.orderBy(F.desc_nulls_last("impact_score"), "finding_id").limit(limit)


def list_run_observations(observations: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return observations.orderBy(F.desc("observed_at"), F.desc("observation_id")).offset(offset).limit(limit)


def list_patterns_by_population(patterns: DataFrame, limit: int, ascending: bool = False) -> DataFrame:
    return patterns.orderBy(F.asc("population_count") if ascending else F.desc("population_count"), "pattern_id").limit(limit)


def top_and_smallest(patterns: DataFrame, top: int = 3) -> DataFrame:
    down = Window.partitionBy("site_id").orderBy(F.desc("population_count"), "pattern_id")
    up = Window.partitionBy("site_id").orderBy("population_count", "pattern_id")
    ranked = patterns.withColumns({"_d": F.row_number().over(down), "_u": F.row_number().over(up)})
    return ranked.where((F.col("_d") <= top) | (F.col("_u") == 1)).withColumn("place", F.when(F.col("_d") <= top, F.col("_d").cast("string")).otherwise("smallest")).drop("_d", "_u")


def list_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("started_at"), F.desc("run_id")).limit(limit)


def pattern_explorer(patterns: DataFrame, findings: DataFrame, observations: DataFrame) -> DataFrame:
    """Patterns with roll-up, worst finding and coverage; by impact."""
    key = ["site_id", "pattern_id"]
    roll = roll_up_pattern_impact(findings).drop("population_count")
    worst = worst_finding(findings).select(*key, F.col("severity_class").alias("worst_severity"), F.col("http_status").alias("worst_status"))
    requests = observations.groupBy(*key).agg((F.count("*") + F.count_if("escalated_to_get")).alias("requests"))
    out = patterns.join(roll, key, "left").join(worst, key, "left").join(requests, key, "left")
    return out.withColumn("coverage", F.when(F.col("population_count") > 0, F.coalesce("requests", F.lit(0)) / F.nullif("population_count", F.lit(0)))).orderBy(F.desc_nulls_last("impact_score"), "pattern_id")


def portfolio(sites: DataFrame, runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Every live site with its latest run, state, findings and critical findings."""
    latest = latest_run_per_site(runs).select("site_id", "run_id", F.col("status").alias("run_status"), "started_at", "total_urls")
    severities = group_severities(findings).drop("severities")
    out = live_sites(sites).join(latest, "site_id", "left").join(severities, "site_id", "left").fillna(0, ["total", "critical"])
    return out.withColumn("state", project_run_state(F.col("run_status"), F.col("total_urls")))


def fleet_totals(rows: DataFrame, now: Column) -> DataFrame:
    return rows.agg(
        F.count("*").alias("sites"), F.count_if(F.col("state") == "in_flight").alias("in_flight"), F.count_if(F.col("run_status").isin("degraded", "failed")).alias("degraded_or_failed"),
        F.coalesce(F.sum("total_urls"), F.lit(0)).alias("urls"), F.coalesce(F.sum("total"), F.lit(0)).alias("findings"), F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
        F.count_if(F.col("total") > 0).alias("sites_affected"), F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 30 DAYS")).alias("onboarded_30_days"),
    )


def fleet_stats(findings: DataFrame, runs: DataFrame) -> DataFrame:
    f = findings.agg(F.count("*").alias("findings"), F.count_distinct("site_id").alias("sites_affected"), F.count_if(F.col("severity_class").isin(*CRITICAL)).alias("critical"), F.count_if(is_absence_of_evidence(F.col("severity_class"))).alias("no_measurement"))
    r = runs.agg(F.count_if(F.col("status").isin("pending", "running")).alias("in_flight"), F.count_if(F.col("status").isin("degraded", "failed")).alias("degraded_or_failed"), F.coalesce(F.sum("total_urls"), F.lit(0)).alias("total_urls"))
    return f.crossJoin(r)  # one row each


def run_report(runs: DataFrame, files: DataFrame, patterns: DataFrame, observations: DataFrame) -> DataFrame:
    """One row for each run: files, patterns, depth, no response, and the number before."""
    key = ["site_id", "run_id"]
    f = files.groupBy(*key).agg(F.count("*").alias("files"), F.count_if(F.col("parse_status") == "failed").alias("files_failed"))
    p = patterns.groupBy(*key).agg(F.count("*").alias("patterns"), F.try_divide(F.sum(F.col("segment_count") * F.col("population_count")), F.sum("population_count")).alias("average_depth"))
    o = observations_with_run(observations, patterns).groupBy(*key).agg(F.count("*").alias("observations"), F.count_if(F.col("http_status").isNull()).alias("no_response"))
    return run_trend(runs).join(f, key, "left").join(p, key, "left").join(o, key, "left").fillna(0, ["files", "files_failed", "patterns", "observations", "no_response"])


def site_analytics(runs: DataFrame, health: DataFrame, patterns: DataFrame, windows: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    return health_series(health, windows), run_status_slices(runs), count_patterns_by_status(patterns)


def pattern_details(findings: DataFrame, observations: DataFrame, populations: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The pages of every pattern's report: its newest findings (20) and observations (200), its files and its population from them."""
    key = ["site_id", "pattern_id"]

    def newest(df: DataFrame, n: int, *order) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")

    return {
        "findings": newest(findings, 20, F.desc("computed_at"), F.asc("finding_id")), "observations": newest(observations, 200, F.desc("observed_at"), F.desc("observation_id")),
        "files": populations_with_file(populations, files), "population": populations.groupBy(*key).agg(F.sum("url_count").alias("population")),
    }


def pattern_detail(site_id: str, pattern_id: str, findings: DataFrame, observations: DataFrame, populations: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """``pattern_details`` of one pattern, in the report's order."""
    key = {"site_id": site_id, "pattern_id": pattern_id}
    pages = {k: by_id(df, **key) for k, df in pattern_details(findings, observations, populations, files).items()}
    order = {"findings": (F.desc("computed_at"), F.asc("finding_id")), "observations": (F.desc("observed_at"), F.desc("observation_id")), "files": (F.desc("url_count"), F.asc("file_id"))}
    return {k: df.orderBy(*order[k]) if k in order else df for k, df in pages.items()}
