"""Runs the streaming jobs over a folder's ``events`` until all that is there has been read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.operators.estimate import findings_of_tallies
from pathsieve.operators.upserts import shared_folder
from pathsieve.plans.derived import TABLES, table
from pathsieve.streaming.jobs import ddl, found, refresh_findings, store_observations, stream_stale_runs, stream_tallies


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def _events(spark: SparkSession, sf_dir: str) -> str:
    """Name of a view of the log as a stream."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    name = f"events_{uuid.uuid4().hex}"
    events.createOrReplaceTempView(name)
    return name


def observation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe log as a stream: ``events`` read file by file, derived as the batch table is."""
    name = _events(spark, sf_dir)
    return spark.sql(TABLES["observation"].replace("FROM events", f"FROM {name}"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB instead of memory, for what is started meanwhile."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations as the idempotent stream stores them."""
    path = _folder(spark)
    with rocksdb(spark):
        store_observations(observation_stream(spark, sf_dir), f"{path}/table").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table").drop("batch")


def run_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tallies, findings) as the stream's last micro-batches leave them."""
    path, samples = _folder(spark), table(spark, sf_dir, "sample").select("site_id", "pattern_id", "sample_id", "population")
    tallies = stream_tallies(observation_stream(spark, sf_dir))
    refresh_findings(tallies, samples, path).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    findings = findings_of_tallies(stream_tallies(table(spark, sf_dir, "observation")).withColumnRenamed("n", "hits"), samples)
    return found(spark, path, ddl(tallies), ddl(findings))


def run_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (one for each user of the log) that fall silent, from the heartbeats in the log."""
    name = _events(spark, sf_dir)
    heartbeats = spark.sql(f"SELECT 'r' || cast(user_id AS string) AS run_id, cast(ts AS timestamp) AS heartbeat_at FROM {name}")
    path = _folder(spark)
    query = stream_stale_runs(heartbeats).writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/table")
    query.awaitTermination()
    return spark.read.schema("run_id string, stale_ms long").parquet(f"{path}/table")


def run_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of refusal circuits in the probe log, read as a stream; the state store is RocksDB while it runs."""
    from pathsieve.streaming.jobs import stream_refusal_circuits

    name = _events(spark, sf_dir)
    probes = spark.sql(TABLES["probe"].replace("FROM events", f"FROM {name}")).select("host", "seq", (F.col("seq") * 30.0).cast("double").alias("at"), F.col("status").cast("long").alias("status"))
    path = _folder(spark)
    with rocksdb(spark):
        stream_refusal_circuits(probes).writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/table").awaitTermination()
    return spark.read.schema("host string, opened_seq long, reason string").parquet(f"{path}/table")
