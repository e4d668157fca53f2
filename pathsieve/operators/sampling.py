"""Reproducible samples: sizes, strata, K smallest hashes, expansion and budgets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    """Bounds of a sample (fixed default values)."""

    least: int = 30
    first: int = 400
    rate: float = 0.01
    most: int = 1200
    factor: float = 3.0
    share: float = 0.25


DEFAULT = Budget()
#: Order of candidates: ties of the hash are broken by where the URL stands.
KEY = ("hash", "file_id", "ordinal")
#: Setting that says up to which k a group is pruned before the shuffle.
PRUNED = "spark.sql.optimizer.windowGroupLimitThreshold"


def _round(x: Column) -> Column:
    """Half up, as ``floor(x + 0.5)``."""
    return F.floor(x + F.lit(0.5)).cast("long")


def first_round_size(population: Column, budget: Budget = DEFAULT) -> Column:
    least = F.least(F.lit(budget.least), population)
    size = F.least(population, F.greatest(least, F.least(F.lit(budget.first), _round(population * F.lit(budget.rate)))))
    return F.when(population <= 0, F.lit(0)).otherwise(size).cast("long")


def k_smallest_sample(df: DataFrame, keys: Sequence[str], k: int | str, order: Sequence[str] = KEY) -> DataFrame:
    """The k rows of each group that come first; k is a number or a column of the group.

    Adding rows, repeating partitions or raising k never removes a row that stays
    among the first. With a number Spark prunes each partition to its first k
    rows before the shuffle. It leaves that out above a threshold of its own,
    1000, and would then move all rows of a group into one task; the session's
    threshold is therefore raised to k.
    """
    if isinstance(k, int) and 0 <= int(df.sparkSession.conf.get(PRUNED)) < k:
        df.sparkSession.conf.set(PRUNED, str(k))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= (F.lit(k) if isinstance(k, int) else F.col(k))).drop("_rank")


def sample_threshold(sample: DataFrame, keys: Sequence[str], capacity: int = DEFAULT.most) -> DataFrame:
    """Largest kept hash of each group at capacity; the largest possible hash below it."""
    return sample.groupBy(*keys).agg(F.when(F.count("*") < capacity, F.lit(0xFFFFFFFF)).otherwise(F.max("hash")).alias("threshold"))


def allocate_strata(strata: DataFrame, keys: Sequence[str], budget: str, minimum: int = DEFAULT.least, population: str = "population", order: str = "stratum") -> DataFrame:
    """``strata`` with ``size``: the group's budget dealt in proportion, at least ``minimum`` each.

    Units are ranked instead of dealt in a loop: what is too much goes from the
    largest sizes above their floor, what is left over goes round by falling
    population. Floors may exceed the budget; no stratum exceeds its population.
    """
    group = Window.partitionBy(*keys)
    p, b = F.col(population), F.col(budget)
    floor = F.least(F.lit(minimum), p)
    s = strata.withColumn("_total", F.sum(population).over(group))
    s = s.withColumn("_size", F.when(F.col("_total") > 0, F.least(p, F.greatest(floor, _round(p / F.col("_total") * b)))).otherwise(F.lit(0)).cast("long"))
    s = s.withColumns({"_floor": floor.cast("long"), "_over": F.sum("_size").over(group) - b})
    ids = [*keys, order]
    # one unit at each level above the floor
    down = s.where("_over > 0 and _size > _floor").select(*ids, "_over", F.explode(F.sequence(F.col("_floor") + 1, F.col("_size"))).alias("level"))
    down = down.withColumn("r", F.row_number().over(group.orderBy(F.desc("level"), F.col(order)))).where("r <= _over").groupBy(*ids).agg((-F.count("*")).alias("change"))
    room = F.least(p - F.col("_size"), -F.col("_over"))
    up = s.where(F.col("_over") < 0).where(room > 0).select(*ids, population, "_over", F.explode(F.sequence(F.lit(1).cast("long"), room.cast("long"))).alias("turn"))
    up = up.withColumn("r", F.row_number().over(group.orderBy("turn", F.desc(population), F.col(order)))).where("r <= -_over").groupBy(*ids).agg(F.count("*").alias("change"))
    return s.join(down.unionByName(up), ids, "left").withColumn("size", (F.col("_size") + F.coalesce("change", F.lit(0))).cast("long")).drop("_total", "_size", "_floor", "_over", "change")


def plan_first_round(strata: DataFrame, keys: Sequence[str], budget: Budget = DEFAULT, population: str = "population", order: str = "stratum") -> DataFrame:
    """Sizes of the first round by stratum, with the group's effective rate."""
    group = Window.partitionBy(*keys)
    planned = strata.withColumn("_budget", first_round_size(F.sum(population).over(group), budget))
    sized = allocate_strata(planned, keys, "_budget", budget.least, population, order).drop("_budget")
    return sized.withColumn("effective_rate", F.try_divide(F.sum("size").over(group), F.sum(population).over(group)))


def draw_samples(patterns: DataFrame, candidates: DataFrame, files: DataFrame, budget: Budget = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(samples, drawn): round 1 of every pattern (pattern_id, population) from its candidates.

    Candidates of unknown files are dropped; a pattern left without any is
    ``needs_review`` with the reason ``NO_RESOLVABLE_CANDIDATES``.
    """
    planned = patterns.select("pattern_id", F.col("population").alias("population_at_draw"), first_round_size(F.col("population"), budget).alias("k_requested"))
    pool = k_smallest_sample(candidates, ["pattern_id"], budget.most)
    limits = sample_threshold(pool, ["pattern_id"], budget.most).withColumnRenamed("threshold", "k_threshold_hash")
    first = k_smallest_sample(pool.join(planned, "pattern_id"), ["pattern_id"], "k_requested")
    drawn = first.join(files.select("file_id"), "file_id", "left_semi")
    sizes = drawn.groupBy("pattern_id").agg(F.count("*").alias("sample_size"))
    samples = planned.join(limits, "pattern_id", "left").join(sizes, "pattern_id", "left").withColumns({
        "sample_size": F.coalesce("sample_size", F.lit(0)), "k_threshold_hash": F.coalesce("k_threshold_hash", F.lit(0xFFFFFFFF)), "round": F.lit(1),
        "status": F.when(F.col("sample_size") > 0, "sampling").otherwise("needs_review"),
        "status_reason": F.when(F.coalesce("sample_size", F.lit(0)) == 0, "NO_RESOLVABLE_CANDIDATES"),
    })
    return samples, drawn


def expand_sample(sample: DataFrame, candidates: DataFrame, plan: DataFrame, keys: Sequence[str], budget: Budget = DEFAULT) -> DataFrame:
    """What the next round adds: the first ``k`` candidates of each group of ``plan`` (keys, k) without those sampled.

    No plan exceeds ``budget.most``, so each partition keeps that many of a group before anything moves.
    """
    candidates = k_smallest_sample(candidates, keys, budget.most)
    larger = k_smallest_sample(candidates.join(plan, list(keys)), keys, "k").drop("k")
    return larger.join(sample.select(*keys, *KEY), [*keys, *KEY], "left_anti")


def probe_budget(samples: DataFrame, per_second: float, limit: int) -> DataFrame:
    total = F.coalesce(F.sum("sample_size"), F.lit(0)).cast("long")
    return samples.agg(total.alias("probes"), (total / F.lit(per_second)).alias("seconds"), (total > limit).alias("over_limit"))


def candidate_file_spread(samples: DataFrame, key: str = "pattern_id") -> DataFrame:
    """min, p50, p95, max and mean of distinct files per group; a quantile is the entry at floor(n * q)."""
    per = samples.groupBy(key).agg(F.count_distinct("file_id").alias("files"))
    counts = per.groupBy("files").agg(F.count("*").alias("groups"))  # few distinct counts, whatever the number of groups
    upto = counts.withColumn("upto", F.sum("groups").over(Window.orderBy("files"))).withColumn("n", F.sum("groups").over(Window.partitionBy()))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))), F.col("files")))

    return upto.agg(
        F.min("files").alias("min_files"), quantile(0.5).alias("p50_files"), quantile(0.95).alias("p95_files"), F.max("files").alias("max_files"),
        (F.sum(F.col("files") * F.col("groups")) / F.sum("groups")).alias("mean_files"),
    )
