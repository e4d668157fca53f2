"""What a pass over URLs leaves behind, as tables that add up with those of other passes.

A pass is four tables: counted paths, the URLs of each template in each file, the
first candidates of each template by hash, and the rules that gave the templates.
Passes over parts of a site (a worker's share, a later crawl, what a run had done
before it broke off) are merged without their URLs: path counts are summed and
decided again, and what was counted for a template goes to the template that its
paths have now. The K smallest hashes of a union are among the K smallest of its
parts, so merged samples are exact as long as templates only grow together.

More evidence can also take a template apart: a slot that looked variable among
few URLs need not look so among many. Its populations are exact even then, for
paths are counted; its file counts and sample can't be divided. Such templates
are named (``apart``), and ``recount`` counts them, and only them, from the URLs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.functions.urls import stable_hash
from pathsieve.operators.patterns import SEP, assign_patterns, learn_from_counts, merge_pattern_passes, path_counts, pattern_population
from pathsieve.operators.sampling import DEFAULT, KEY, k_smallest_sample, sample_threshold
from pathsieve.operators.upserts import checkpointed

PARTS = ("paths", "files", "sample", "rules", "apart")


@dataclass(frozen=True)
class Pass:
    """paths (path, n); files (template, file_id, url_count); sample (template, key, path, hash, file_id, ordinal), the ``capacity`` first of each template; rules (parent, literal); apart (template), those that a merge left without exact files and samples."""

    paths: DataFrame
    files: DataFrame
    sample: DataFrame
    rules: DataFrame
    apart: DataFrame
    capacity: int

    def save(self, folder: str) -> None:
        """Parquet tables in a folder that executors share; what is there is replaced."""
        for part in PARTS:
            getattr(self, part).write.mode("overwrite").parquet(f"{folder}/{part}")
        self.rules.sparkSession.range(1).select(F.lit(self.capacity).alias("capacity")).write.mode("overwrite").parquet(f"{folder}/state")


def load(spark: SparkSession, folder: str) -> Pass:
    return Pass(*(spark.read.parquet(f"{folder}/{part}") for part in PARTS), spark.read.parquet(f"{folder}/state").first().capacity)


def _segments(path: str = "key"):
    return F.when(F.col(path) == "", F.array().cast("array<string>")).otherwise(F.split(path, SEP))


def _assigned(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with ``key`` (joined segments) and their template."""
    return assign_patterns(keyed.withColumn("_segments", _segments()), rules, "_segments").drop("_segments")


def _counted(urls: DataFrame, rules: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    assigned = assign_patterns(urls, rules).withColumns({"hash": stable_hash(F.col("path")), "key": F.array_join("segments", SEP)})
    sample = k_smallest_sample(assigned.select("template", "key", "path", *KEY), ["template"], capacity)
    return pattern_population(assigned), sample


def observe(urls: DataFrame, rules: DataFrame | None = None, capacity: int = DEFAULT.most) -> Pass:
    """The pass over ``urls`` (segments, path, file_id, ordinal); rows without segments are left out.

    ``rules`` (an earlier pass's, say) only say how candidates are grouped until
    passes are merged; without them the pass learns its own. ``capacity`` bounds
    what is kept of a template and is that of the largest sample wanted later.
    """
    urls = urls.where(F.col("segments").isNotNull())
    paths = path_counts(urls)
    if rules is None:
        paths = checkpointed(paths)
        rules = learn_from_counts(paths)
    none = urls.sparkSession.createDataFrame([], "template string")
    return Pass(paths, *_counted(urls, rules, capacity), rules, none, capacity)


def merge(*passes: Pass) -> Pass:
    """One pass from several, decided on their evidence together."""
    capacity = min(p.capacity for p in passes)
    paths = checkpointed(merge_pattern_passes(*(p.paths for p in passes)))
    rules = learn_from_counts(paths)
    files, samples, apart = [], [], []
    for p in passes:
        own = _assigned(p.paths.withColumnRenamed("path", "key"), p.rules).withColumnRenamed("template", "old")
        now = _assigned(own, rules).groupBy("old").agg(F.min("template").alias("template"), (F.min("template") != F.max("template")).alias("divided"), F.collect_set("template").alias("_all"))
        now = checkpointed(now)
        moved = p.files.withColumnRenamed("template", "old").join(now.where("not divided").select("old", "template"), "old")
        files.append(moved.select("template", "file_id", "url_count"))
        # a candidate knows its path, so it goes where its path goes
        samples.append(_assigned(p.sample.drop("template"), rules))
        apart.append(now.where("divided").select(F.explode("_all").alias("template")))
        apart.append(_templates_of(p.apart, now))
    lost = checkpointed(reduce(DataFrame.unionByName, apart).distinct())
    counted = reduce(DataFrame.unionByName, files).groupBy("template", "file_id").agg(F.sum("url_count").alias("url_count"))
    sample = k_smallest_sample(reduce(DataFrame.unionByName, samples), ["template"], capacity)
    return Pass(paths, counted.join(lost, "template", "left_anti"), sample.join(lost, "template", "left_anti"), rules, lost, capacity)


def _templates_of(old: DataFrame, now: DataFrame) -> DataFrame:
    return now.join(old.withColumnRenamed("template", "old"), "old", "left_semi").select(F.explode("_all").alias("template"))


def recount(merged: Pass, urls: DataFrame) -> Pass:
    """``merged`` with the files and samples of the templates that came apart, from the URLs of all its passes."""
    if merged.apart.isEmpty():
        return merged
    urls = assign_patterns(urls.where(F.col("segments").isNotNull()), merged.rules).join(merged.apart, "template", "left_semi").drop("template")
    files, sample = _counted(urls, merged.rules, merged.capacity)
    none = merged.apart.limit(0)
    return Pass(merged.paths, merged.files.unionByName(files), merged.sample.unionByName(sample), merged.rules, none, merged.capacity)


def summary(state: Pass) -> DataFrame:
    """(template, segment_count, population_count, file_count, sample_size, threshold, exact) of every template; files and samples of one that came apart are null until it is recounted."""
    assigned = _assigned(state.paths.withColumnRenamed("path", "key"), state.rules)
    populations = assigned.groupBy("template").agg(F.sum("n").alias("population_count"))
    arity = F.when(F.col("template") == "/", 0).otherwise(F.size(F.split("template", "/")) - 1)
    files = state.files.groupBy("template").agg(F.count("*").alias("file_count"))
    sizes = state.sample.groupBy("template").agg(F.count("*").alias("sample_size"))
    out = populations.join(files, "template", "left").join(sizes, "template", "left").join(sample_threshold(state.sample, ["template"], state.capacity), "template", "left")
    lost = state.apart.select(F.col("template"), F.lit(False).alias("_exact"))
    return out.join(lost, "template", "left").select("template", arity.alias("segment_count"), "population_count", "file_count", "sample_size", "threshold", F.coalesce("_exact", F.lit(True)).alias("exact"))
