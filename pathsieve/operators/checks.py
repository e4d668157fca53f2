"""Table quality: rows that violate a rule, with the rule's name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed values of each enumeration (fixed values).
ENUMS = {
    "run_status": ("pending", "running", "complete", "degraded", "failed", "cancelled"),
    "file_parse_status": ("pending", "downloading", "parsing", "parsed", "failed", "skipped"),
    "pattern_status": ("unsampled", "sampling", "measured", "blocked", "needs_review"),
    "evidence_tier": ("counted", "estimated", "blocked"),
    "confidence_band": ("confident", "approximate", "low"),
    "site_tier": ("standard", "priority", "bulk"),
    "http_method": ("HEAD", "GET"),
    "severity_class": ("gone", "not_found", "soft_not_found", "server_error", "redirect_chain", "redirect_single", "ok", "blocked", "unknown"),
}


def violations(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys, rule) of every rule a row breaks; all rules are tested in one pass. A rule that is null holds."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


def finding_rules() -> dict[str, Column]:
    """Counts, interval, degenerate interval, tier and impact of findings (Q1 to Q4)."""
    c = F.col
    blocked = c("evidence_tier") == "blocked"
    quiet = c("severity_class").isin("blocked", "unknown", "ok")
    return {
        "counts_sane": (c("observed_count") >= 0) & (c("observed_count") <= c("sample_size")) & (c("sample_size") <= c("population_count")),
        "interval_ordered": (c("ci_low") >= 0) & (c("ci_low") <= c("point_estimate")) & (c("point_estimate") <= c("ci_high")) & (c("ci_high") <= c("population_count")),
        "interval_not_degenerate": blocked | (c("sample_size") >= c("population_count")) | (c("ci_low") < c("ci_high")),
        "tier_matches_coverage": blocked | ((c("evidence_tier") == "counted") == (c("sample_size") >= c("population_count"))),
        "impact_in_range": (c("impact_score") >= 0) & (c("impact_score") <= c("point_estimate")) & c("severity_weight").between(0, 1),
        "no_impact_without_harm": ~quiet | ((c("impact_score") == 0) & (c("severity_weight") == 0)),
    }


def domain_rules() -> dict[str, dict[str, Column]]:
    """Q7 by table."""
    c = F.col
    return {
        "pattern": {"population_not_negative": c("population_count") >= 0, "status_domain": c("status").isin(*ENUMS["pattern_status"])},
        "pattern_population": {"url_count_positive": c("url_count") > 0},
        "pattern_sample": {"round_positive": c("round") >= 1, "sample_within_population": c("sample_size") <= c("population_at_draw")},
        "sampling_health": {"window_ordered": c("window_start") < c("window_end")},
        "sitemap_run": {"status_domain": c("status").isin(*ENUMS["run_status"])},
        "site": {"tier_domain": c("tier").isin(*ENUMS["site_tier"])},
    }


def orphans(child: DataFrame, parent: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Children whose (site, id) pair has no parent (Q5)."""
    return child.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))).join(parent.select(*key), list(key), "left_anti").select(*key, F.lit(rule).alias("rule"))


def duplicates(df: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Keys that occur more than once (Q6)."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("rule", F.lit(rule))


def several_active_runs(runs: DataFrame) -> DataFrame:
    return duplicates(runs.where(F.col("status").isin("pending", "running")), ["site_id"], "one_active_run")


def population_mismatch(patterns: DataFrame, populations: DataFrame) -> DataFrame:
    """Patterns whose files don't add up to their population (Q8)."""
    sums = populations.groupBy("site_id", "pattern_id").agg(F.sum("url_count").alias("from_files"))
    out = patterns.join(sums, ["site_id", "pattern_id"], "left").withColumn("from_files", F.coalesce("from_files", F.lit(0)))
    return out.where("from_files <> population_count").select("site_id", "pattern_id", "population_count", "from_files", F.lit("population_adds_up").alias("rule"))
