import random

import pytest
from pyspark.sql import functions as F

from pathsieve.operators import checks, estimate, patterns, probes, sampling, upserts


@pytest.mark.parametrize(("hits", "n", "population", "want"), [
    (1, 20, None, (0.05, 0.00891, 0.23611)), (5, 50, None, (0.1, 0.04348, 0.21358)), (10, 20, None, (0.5, 0.2993, 0.7007)), (20, 20, None, (1.0, 0.83887, 1.0)),
    (0, 0, None, (0.0, 0.0, 1.0)), (0, 40, 40, (0.0, 0.0, 0.0)), (7, 40, 40, (0.175, 0.175, 0.175)), (0, 30, 40_000, (0.0, 0.0, 0.11348)),
])
def test_wilson(spark, hits, n, population, want):
    df = spark.createDataFrame([(hits, n, population)], "h int, n int, p long")
    got = df.select(estimate.wilson_interval(F.col("h"), F.col("n"), F.col("p")).alias("w")).first().w
    assert (got.point, got.low, got.high) == pytest.approx(want, abs=1e-4)


def test_wilson_refuses_impossible_counts(spark):
    df = spark.createDataFrame([(3, 2)], "h int, n int")
    with pytest.raises(Exception, match="hits, sampled"):
        df.select(estimate.wilson_interval(F.col("h"), F.col("n"))).collect()


def test_stratified(spark):
    rows = [("a", "x", 9000, 90, 0), ("a", "y", 200, 10, 10), ("b", "x", 40_000, 400, 8), ("c", "x", 90_000_000, 400, 60), ("d", "x", 100, 0, 0), ("e", "x", 10, 10, 3)]
    df = spark.createDataFrame(rows, "id string, label string, population long, sampled long, hits long")
    got = {r.id: r for r in estimate.measure_proportion(df, ["id"]).collect()}
    assert got["a"].point_estimate == 200 and got["b"].point_estimate == 800
    assert got["c"].point_estimate == 13_500_000 and got["c"].confidence_band == "approximate"
    assert (got["d"].point_estimate, got["d"].ci_high, got["d"].unsampled_strata) == (0, 100, ["x"])
    assert got["e"].is_counted and got["e"].evidence_tier == "counted" and got["e"].confidence_band == "confident"
    plan = {r.id: r for r in estimate.plan_expansion(df, ["id"]).collect()}
    assert not plan["c"].should_expand and plan["c"].reason == "already_precise"
    assert plan["e"].reason == "already_precise"


@pytest.mark.parametrize(("population", "size"), [(300, 30), (1000, 30), (12, 12), (1, 1), (10_000, 100), (40_000_000, 400), (0, 0)])
def test_first_round(spark, population, size):
    assert spark.createDataFrame([(population,)], "p long").select(sampling.first_round_size(F.col("p")).alias("s")).first().s == size


def dealt(populations, budget, minimum):
    """One unit at a time: from the largest above its floor while there is too much, round by population while there is too little."""
    total = sum(populations)
    if not total:
        return [0] * len(populations)
    sizes = [min(p, max(min(minimum, p), int(p / total * budget + 0.5))) for p in populations]
    while sum(sizes) > budget:
        above = [i for i, s in enumerate(sizes) if s > min(minimum, populations[i])]
        if not above:
            break
        sizes[max(above, key=lambda i: (sizes[i], -i))] -= 1
    order = sorted(range(len(sizes)), key=lambda i: (-populations[i], i))
    while sum(sizes) < budget and any(sizes[i] < populations[i] for i in order):
        for i in order:
            if sizes[i] < populations[i] and sum(sizes) < budget:
                sizes[i] += 1
    return sizes


def test_allocation_follows_the_loop(spark):
    pick, rows, want = random.Random(2), [], {}
    for g in range(150):
        populations = [pick.choice([0, 1, 3, 20, 100, 5000]) for _ in range(pick.randint(1, 6))]
        budget, minimum = pick.randint(0, 120), 5
        for i, n in enumerate(dealt(populations, budget, minimum)):
            want[g, i] = n
        rows += [(g, i, p, budget) for i, p in enumerate(populations)]
    df = spark.createDataFrame(rows, "g int, stratum int, population long, budget long")
    got = {(r.g, r.stratum): r.size for r in sampling.allocate_strata(df, ["g"], "budget", 5).collect()}
    assert got == want


def test_k_smallest_is_a_superset_and_prunes_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("pattern_id"), (F.xxhash64("id") % 1000).alias("hash"), F.lit(1).alias("file_id"), F.col("id").alias("ordinal"))
    a = sampling.k_smallest_sample(df, ["pattern_id"], 50)
    b = sampling.k_smallest_sample(df.repartition(7), ["pattern_id"], 90)
    assert a.join(b, ["pattern_id", "hash", "file_id", "ordinal"], "left_anti").count() == 0 and b.count() == 270
    assert a._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


@pytest.mark.parametrize("k", [1200, 3000])
def test_many_smallest_are_pruned_before_the_shuffle_too(spark, k):
    df = spark.range(20_000).select((F.col("id") % 3).alias("pattern_id"), (F.xxhash64("id") % 1000).alias("hash"), F.lit(1).alias("file_id"), F.col("id").alias("ordinal"))
    got = sampling.k_smallest_sample(df, ["pattern_id"], k)
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    want = [x for p in range(3) for x in sorted((p, r.hash, r.ordinal) for r in df.collect() if r.pattern_id == p)[:k]]
    assert sorted((r.pattern_id, r.hash, r.ordinal) for r in got.collect()) == want


def test_drawn_samples_come_from_pruned_groups(spark):
    c = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("pattern_id"), (F.xxhash64("id") % 1000).alias("hash"), (F.col("id") % 7).alias("file_id"), F.col("id").alias("ordinal"))
    known = spark.createDataFrame([("0", 6667), ("1", 6667), ("2", 6666)], "pattern_id string, population long")
    samples, _ = sampling.draw_samples(known, c, c.select("file_id").distinct())
    assert samples._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
    first = {p: sorted((r.hash, r.file_id, r.ordinal) for r in c.where(F.col("pattern_id") == p).collect()) for p in "012"}
    assert {r.pattern_id: (r.k_requested, r.sample_size, r.k_threshold_hash) for r in samples.collect()} == {p: (67, 67, first[p][1199][0]) for p in "012"}


def test_expansion_reads_pruned_groups(spark):
    c = spark.range(20_000).select((F.col("id") % 3).alias("pattern_id"), (F.xxhash64("id") % 1000).alias("hash"), (F.col("id") % 7).alias("file_id"), F.col("id").alias("ordinal"))
    plan = spark.createDataFrame([(0, 1100), (1, 5)], "pattern_id long, k int")
    more = sampling.expand_sample(sampling.k_smallest_sample(c, ["pattern_id"], 100), c, plan, ["pattern_id"])
    assert more._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
    want = sorted((r.hash, r.file_id, r.ordinal) for r in c.where("pattern_id = 0").collect())[100:1100]
    assert sorted((r.hash, r.file_id, r.ordinal) for r in more.collect()) == want


def corpus(spark, n=50_000):
    from pathsieve.sources.sitemaps import generate_url_corpus

    return patterns.split_locs(generate_url_corpus(spark, n), "https://example.com/", "example.com")


def test_patterns_of_the_seeded_corpus(spark):
    u = corpus(spark).cache()
    rules = patterns.learn_patterns(u)
    found = {r.template: r.population_count for r in patterns.pattern_summary(patterns.assign_patterns(u, rules)).collect()}
    assert sum(found.values()) == 50_000
    assert {"/part/{param}", "/legacy/discontinued/{param}", "/{param}/page/{param}", "/search", "/shop/seals/{param}"} <= set(found)
    assert "/{param}" not in found and len(found) == 19
    again = patterns.assign_patterns(u, patterns.learn_patterns(u.repartition(5)))
    assert {r.template: r.population_count for r in patterns.pattern_summary(again).collect()} == found


def test_few_urls_keep_their_names(spark):
    u = spark.createDataFrame([(1, ["a", str(i)]) for i in range(29)] + [(1, [])], "file_id int, segments array<string>")
    got = {r.template for r in patterns.assign_patterns(u, patterns.learn_patterns(u)).collect()}
    assert got == {f"/a/{i}" for i in range(29)} | {"/"}
    assert patterns.learn_patterns(u.limit(0)).count() == 0


def test_probe_logs(spark):
    log = [("h", "p", i, 429, 20, False, False) for i in range(5)] + [("g", "q", i, 405, 5, True, False) for i in range(3)] + [("g", "r", i, 200, 5, False, False) for i in range(10, 14)]
    df = spark.createDataFrame(log, "host string, pattern_id string, seq long, status int, planned long, escalated boolean, is_soft_404 boolean")
    got = {r.pattern_id: (r.verdict, r.reason) for r in probes.pattern_verdict(df).collect()}
    assert got == {"p": ("blocked", "TOO_MANY_REQUESTS"), "q": ("needs_review", "HEAD_NOT_SUPPORTED"), "r": ("measured", None)}
    timed = spark.createDataFrame([("h", i, i * 10.0, 429) for i in range(60)], "host string, seq long, at double, status int")
    assert [r.opened_seq for r in probes.refusal_circuits(timed).orderBy("opened_seq").collect()] == [4, 38]


def test_upserts_and_checks(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (3, "c"), (3, "d"), (None, "e")], "k int, v string")
    assert sorted(str(r.k) for r in upserts.append_new(new, old, ["k"], "v").collect()) == ["3", "None"]
    assert {(r.k, r.v) for r in upserts.upsert_replace(old, new.where("k = 1"), ["k"]).collect()} == {(1, "b"), (2, None)}
    bad = spark.createDataFrame([(1, 5, 4, 10, 3, 1, 2, "estimated", "ok", 1.0, 0.5)], "id int, observed_count int, sample_size int, population_count int, point_estimate int, ci_low int, ci_high int, evidence_tier string, severity_class string, impact_score double, severity_weight double")
    assert {r.rule for r in checks.violations(bad, checks.finding_rules(), ["id"]).collect()} == {"counts_sane", "interval_ordered", "no_impact_without_harm"}
