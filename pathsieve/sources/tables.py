"""Tables written and exported: partitioned by site, and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathsieve.operators.reports import portfolio

#: Columns of the two exports, in order (fixed values).
OBSERVATION_COLUMNS = ("url", "pattern", "http_status", "method", "escalated_to_get", "is_soft_404", "error_reason", "response_ms", "observed_at")
PORTFOLIO_COLUMNS = ("site_id", "name", "host", "tier", "state", "run_id", "run_status", "started_at", "total_urls", "total", "critical", "created_at")


#: Rows of a file, about, sites whose sizes are broadcast at most, and tasks of a write.
FILE_ROWS, BROADCAST, MOST_TASKS = 1_000_000, 1 << 16, 100_000


def write_partitioned(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet in one folder for each site, with as many files as the site's rows fill.

    Sites are counted first: a small site is one file, a large one is dealt out
    by a hash of its rows, and there is a task for each file, about.
    """
    sizes = df.groupBy(F.col("site_id").alias("_site")).agg(F.ceil(F.count("*") / FILE_ROWS).alias("_files"))
    sites, files = sizes.agg(F.count("*"), F.coalesce(F.sum("_files"), F.lit(0))).first()
    sizes = F.broadcast(sizes) if sites <= BROADCAST else sizes
    dealt = df.join(sizes, F.col("site_id").eqNullSafe(F.col("_site"))).withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.col("_files")))
    dealt.repartition(max(1, min(files, MOST_TASKS)), "site_id", "_file").drop("_site", "_files", "_file").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("site_id").parquet(path)


def observation_rows(observations: DataFrame) -> DataFrame:
    """Rows of the observation export, newest first, all of them."""
    iso = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return observations.orderBy(F.desc("observed_at"), F.desc("observation_id")).withColumn("observed_at", iso).select(*OBSERVATION_COLUMNS)


def _write_csv(df: DataFrame, path: str) -> None:
    text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    text.write.mode("overwrite").csv(path, header=True, quoteAll=True, emptyValue='""', escape='"')


def export_observations_csv(observations: DataFrame, path: str) -> None:
    _write_csv(observation_rows(observations), path)


def export_portfolio_csv(sites: DataFrame, runs: DataFrame, findings: DataFrame, path: str) -> None:
    _write_csv(portfolio(sites, runs, findings).select(*PORTFOLIO_COLUMNS).orderBy("site_id"), path)
