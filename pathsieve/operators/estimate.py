"""Estimates: Wilson intervals, stratified totals, precision bands, impact and expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathsieve.functions.status import SEVERITY_WEIGHTS, classify_outcome, is_absence_of_evidence, severity_weight
from pathsieve.operators.sampling import DEFAULT, Budget, _round, allocate_strata

#: Normal quantiles of the three supported levels (fixed values).
Z = {0.9: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}
ESTIMATOR_VERSION = "1.0.0"
#: Relative widths below which an estimate is confident or approximate, with and without hits (fixed values).
APPROXIMATE_WIDTH, LOW_WIDTH, ZERO_APPROXIMATE_WIDTH, ZERO_LOW_WIDTH = 0.2, 0.5, 0.02, 0.1
BANDS = ("low", "approximate", "confident")


def wilson_interval(hits: Column, sampled: Column, population: Column | None = None, level: float = 0.95) -> Column:
    """struct(point, low, high) of a proportion; a finite population narrows it towards the point. Impossible counts are an error."""
    if level not in Z:
        raise ValueError(f"level must be one of {sorted(Z)}")
    z, n = F.lit(Z[level]), sampled.cast("double")
    point = hits / n
    zn = z * z / n
    denominator = F.lit(1.0) + zn
    centre = (point + zn / F.lit(2.0)) / denominator
    half = z / denominator * F.sqrt(point * (F.lit(1.0) - point) / n + z * z / (F.lit(4.0) * n * n))
    low, high = centre - half, centre + half
    bad = (hits < 0) | (hits > sampled)
    if population is not None:
        shrink = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - n / population.cast("double")))
        known = population.isNotNull()
        low, high = F.when(known, point - (point - low) * shrink).otherwise(low), F.when(known, point + (high - point) * shrink).otherwise(high)
        bad = bad | (population < sampled)
    low = F.least(F.least(F.lit(1.0), F.greatest(F.lit(0.0), low)), point)
    high = F.greatest(F.least(F.lit(1.0), F.greatest(F.lit(0.0), high)), point)
    unknown = F.struct(F.lit(0.0).alias("point"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    some = F.struct(point.alias("point"), low.alias("low"), high.alias("high"))
    error = F.raise_error(F.lit("hits, sampled and population must satisfy 0 <= hits <= sampled <= population")).cast("struct<point:double,low:double,high:double>")
    return F.when(F.coalesce(bad, F.lit(False)), error).when(sampled <= 0, unknown).otherwise(some)


def relative_width(point: Column, low: Column, high: Column, population: Column) -> Column:
    width = F.greatest(F.lit(0), high - low)
    return (
        F.when(point > 0, width / F.nullif(point, F.lit(0))).when(width == 0, F.lit(0.0))
        .when(population <= 0, F.lit(float("inf"))).otherwise(width / F.nullif(population, F.lit(0)))
    ).cast("double")


def confidence_band(point: Column, low: Column, high: Column, population: Column, is_counted: Column) -> Column:
    width, none = relative_width(point, low, high, population), point <= 0
    return (
        F.when(is_counted, "confident").when(width < F.when(none, F.lit(ZERO_APPROXIMATE_WIDTH)).otherwise(F.lit(APPROXIMATE_WIDTH)), "confident")
        .when(width < F.when(none, F.lit(ZERO_LOW_WIDTH)).otherwise(F.lit(LOW_WIDTH)), "approximate").otherwise("low")
    )


def estimate_stratified(strata: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """Totals of each group from its strata (label, population, sampled, hits).

    An unsampled stratum adds nothing to the point and the low end and all of its
    population to the high end. Rounding comes last, and the interval always
    holds the point.
    """
    rate = wilson_interval(F.col("hits"), F.col("sampled"), F.when(F.col("sampled") > 0, F.col("population")), level)
    n = F.col("population").cast("double")
    open_ = F.col("sampled") <= 0
    rows = strata.withColumn("_rate", rate)
    rows = rows.withColumns({"_point": F.when(open_, 0.0).otherwise(n * F.col("_rate.point")), "_low": F.when(open_, 0.0).otherwise(n * F.col("_rate.low")), "_high": F.when(open_, n).otherwise(n * F.col("_rate.high"))})
    part = F.struct("label", "population", "sampled", "hits", _round(F.col("_point")).alias("estimated"), _round(F.col("_low")).alias("low"), _round(F.col("_high")).alias("high"))
    out = rows.groupBy(*keys).agg(
        F.sum("population").alias("population_count"), F.sum("sampled").alias("sample_size"), F.sum("hits").alias("observed_count"),
        _round(F.sum("_point")).alias("point_estimate"), _round(F.sum("_low")).alias("ci_low"), _round(F.sum("_high")).alias("ci_high"),
        F.sort_array(F.collect_list(part)).alias("strata"), F.sort_array(F.collect_list(F.when(open_ & (F.col("population") > 0), F.col("label")))).alias("unsampled_strata"),
        F.bool_and(F.col("sampled") >= F.col("population")).alias("_full"),
    )
    return out.withColumns({
        "ci_low": F.least("ci_low", "point_estimate"), "ci_high": F.greatest("ci_high", "point_estimate"),
        "is_counted": F.col("_full") & (F.col("population_count") > 0), "confidence_level": F.lit(level),
    }).drop("_full")


def measure_proportion(strata: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """``estimate_stratified`` with evidence tier, precision band and estimator version."""
    e = estimate_stratified(strata, keys, level)
    return e.withColumns({
        "evidence_tier": F.when(F.col("is_counted"), "counted").otherwise("estimated"),
        "confidence_band": confidence_band(F.col("point_estimate"), F.col("ci_low"), F.col("ci_high"), F.col("population_count"), F.col("is_counted")),
        "estimator_version": F.lit(ESTIMATOR_VERSION),
    })


def score_impact(findings: DataFrame, weights: dict[str, float] = SEVERITY_WEIGHTS, traffic: float = 1.0) -> DataFrame:
    """Adds severity_weight, impact_score and its bounds; ``traffic`` is in (0, 1]."""
    if not 0 < traffic <= 1:
        raise ValueError("traffic must be above 0 and at most 1")
    w = severity_weight(F.col("severity_class"), weights)
    return findings.withColumn("severity_weight", w).withColumns({
        **{name: F.col(source) * F.col("severity_weight") * F.lit(traffic) for name, source in (("impact_score", "point_estimate"), ("impact_low", "ci_low"), ("impact_high", "ci_high"))},
        "is_absence_of_evidence": is_absence_of_evidence(F.col("severity_class")),
    })


def score_pattern_impact(findings: DataFrame, keys: Sequence[str] = ("site_id", "pattern_id"), order: str = "finding_id") -> DataFrame:
    """Impact of each pattern: sums over findings that are evidence, and its worst finding (first on ties)."""
    real = ~F.col("is_absence_of_evidence")
    return findings.groupBy(*keys).agg(
        *(F.coalesce(F.sum(F.when(real, F.col(c))), F.lit(0.0)).alias(n) for n, c in (("total", "impact_score"), ("total_low", "impact_low"), ("total_high", "impact_high"))),
        F.min_by("severity_class", F.when(real, F.struct((-F.col("impact_score")).alias("a"), F.col(order).alias("b")))).alias("worst_severity"),
        (F.count_if(real) == 0).alias("is_unmeasured"),
    )


def rank_by_impact(scored: DataFrame, total: str = "total", key: str = "pattern_id") -> DataFrame:
    return scored.orderBy(F.desc(total), F.col(key))


def build_findings(observations: DataFrame, samples: DataFrame, level: float = 0.95, label: str | None = None, weights: dict[str, float] = SEVERITY_WEIGHTS) -> DataFrame:
    """One finding for each (sample, status, soft 404) of the observations, with its estimate and impact.

    Every observation is in the denominator, those without a response too; they
    make no finding. A sample without observations gives one ``blocked`` finding.
    ``samples`` has site_id, pattern_id, sample_id and population; with ``label``
    the observations' column of that name divides the sample, and ``samples`` has
    one row for each label.
    """
    parts = ["stratum_label"] if label else []
    o = observations.withColumn("is_soft_404", F.coalesce("is_soft_404", F.lit(False)))
    o = o.withColumn("stratum_label", F.col(label)) if label else o
    tally = o.groupBy("site_id", "sample_id", *parts, "http_status", "is_soft_404").agg(F.count("*").alias("hits"))
    return findings_of_tallies(tally, samples.withColumnRenamed(label, "stratum_label") if label else samples, level, bool(label), weights)


def findings_of_tallies(tally: DataFrame, samples: DataFrame, level: float = 0.95, stratified: bool = False, weights: dict[str, float] = SEVERITY_WEIGHTS) -> DataFrame:
    """``build_findings`` from counts (site_id, sample_id, http_status, is_soft_404, hits), by stratum_label if ``stratified``."""
    keys = ["site_id", "pattern_id", "sample_id"]
    group = ["http_status", "is_soft_404"]
    parts = ["stratum_label"] if stratified else []
    s = samples.select(*keys, "population", *parts)
    sampled = tally.groupBy("site_id", "sample_id", *parts).agg(F.sum("hits").alias("sampled"))
    outcomes = tally.where("http_status is not null").select("site_id", "sample_id", *group).distinct()
    # every outcome of a sample meets every stratum of it
    strata = s.join(sampled, ["site_id", "sample_id", *parts], "left").join(outcomes, ["site_id", "sample_id"])
    strata = strata.join(tally.where("http_status is not null"), ["site_id", "sample_id", *parts, *group], "left").select(
        *keys, *group, (F.col("stratum_label") if stratified else F.lit("all")).alias("label"), F.greatest("population", F.coalesce("sampled", F.lit(0))).alias("population"), F.coalesce("sampled", F.lit(0)).alias("sampled"), F.coalesce("hits", F.lit(0)).alias("hits")
    )
    found = measure_proportion(strata, [*keys, *group], level).withColumn("severity_class", classify_outcome(F.col("http_status"), F.col("is_soft_404")))
    silent = s.groupBy(*keys).agg(F.sum("population").alias("population_count")).join(outcomes.select("site_id", "sample_id").distinct(), ["site_id", "sample_id"], "left_anti")
    silent = silent.join(sampled.select("site_id", "sample_id").distinct(), ["site_id", "sample_id"], "left_anti")
    blocked = silent.select(
        *keys, F.lit(0).alias("http_status"), F.lit(False).alias("is_soft_404"), "population_count", *(F.lit(0).cast("long").alias(c) for c in ("sample_size", "observed_count", "point_estimate", "ci_low", "ci_high")),
        F.lit(level).alias("confidence_level"), F.lit("blocked").alias("evidence_tier"), F.lit("low").alias("confidence_band"), F.lit(ESTIMATOR_VERSION).alias("estimator_version"), F.lit("blocked").alias("severity_class"),
    )
    return score_impact(found.drop("is_counted", "unsampled_strata").unionByName(blocked, allowMissingColumns=True), weights)


def plan_expansion(strata: DataFrame, keys: Sequence[str], budget: Budget = DEFAULT, level: float = 0.95) -> DataFrame:
    """(keys, should_expand, reason, additional_total, strata) of each group of strata (label, population, sampled, hits)."""
    e = measure_proportion(strata, keys, level)
    n, total = F.col("sample_size"), F.col("population_count")
    absolute, relative = F.lit(budget.most) - n, _round(n * F.lit(budget.factor - 1))
    share = F.floor(total * F.lit(budget.share)) - n
    unsampled = F.size("unsampled_strata") > 0
    gate = (
        F.when(F.col("is_counted"), "already_precise").when(~unsampled & (F.col("confidence_band") != "low"), "already_precise")
        .when(absolute <= 0, "at_expansion_ceiling").when(share <= 0, "at_population_ceiling").when(F.least(absolute, relative, share) <= 0, "at_expansion_ceiling")
    )
    gated = e.select(*keys, "strata", gate.alias("_gate"), unsampled.alias("_unsampled"), F.least(absolute, relative, share).alias("_room"))
    rows = gated.where("_gate is null").select(*keys, "_unsampled", "_room", F.inline("strata"))
    wide = (F.col("sampled") < F.col("population")) & (relative_width(F.col("estimated"), F.col("low"), F.col("high"), F.col("population")) >= LOW_WIDTH)
    group = Window.partitionBy(*keys)
    rows = rows.withColumn("_any", F.bool_or(wide).over(group))
    target = F.when(F.col("_unsampled"), (F.col("sampled") <= 0) & (F.col("population") > 0)).when(F.col("_any"), wide).otherwise(F.col("sampled") < F.col("population"))
    rows = rows.where(target).withColumn("headroom", F.greatest(F.lit(0), F.col("population") - F.col("sampled")))
    rows = rows.withColumn("_budget", F.least("_room", F.sum("headroom").over(group)))
    dealt = allocate_strata(rows.select(*keys, "label", "headroom", "_budget"), keys, "_budget", 0, "headroom", "label").where("size > 0")
    added = dealt.groupBy(*keys).agg(F.sum("size").alias("additional_total"), F.sort_array(F.collect_list(F.struct("label", F.col("size").alias("additional")))).alias("added"))
    reason = F.coalesce("_gate", F.when(F.col("additional_total").isNull(), "nothing_left_to_sample").when(F.col("_unsampled"), "unsampled_strata").otherwise("interval_too_wide"))
    return gated.join(added, list(keys), "left").select(*keys, (F.col("_gate").isNull() & F.col("additional_total").isNotNull()).alias("should_expand"), reason.alias("reason"), F.coalesce("additional_total", F.lit(0)).alias("additional_total"), F.col("added").alias("strata"))


def what_if_plan(table: DataFrame) -> DataFrame:
    """Plan, measurement and expansion decision for rows of (id, population, sampled, hits)."""
    from pathsieve.operators.sampling import first_round_size

    strata = table.withColumn("label", F.lit("all"))
    measured = measure_proportion(strata, ["id"]).drop("strata", "unsampled_strata")
    expansion = plan_expansion(strata, ["id"]).select("id", "should_expand", "reason", "additional_total")
    return measured.join(expansion, "id").withColumn("first_round", first_round_size(F.col("population_count")))
