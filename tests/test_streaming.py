import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathsieve.operators.probes import refusal_circuits
from pathsieve.operators.estimate import findings_of_tallies
from pathsieve.streaming import jobs
from pathsieve.streaming.jobs import stream_circuit_events, stream_observations, stream_refusal_circuits, stream_stale_runs, stream_tallies


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_circuits_open_as_in_the_batch(spark, tmp_path):
    rows = pd.DataFrame([(f"h{i % 3}", i, i * 7.0, 429 if i % 9 else 200) for i in range(300)], columns=["host", "seq", "at", "status"])
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("host string, seq long, at double, status long").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    drained(stream_refusal_circuits(stream).writeStream.format("memory").queryName("circuits").option("checkpointLocation", f"{tmp_path}/c").start())
    want = {(r.host, r.opened_seq, r.reason) for r in refusal_circuits(spark.createDataFrame(rows)).collect()}
    assert {(r.host, r.opened_seq, r.reason) for r in spark.table("circuits").collect()} == want and want


def test_a_circuit_closes_without_a_probe(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = []
    # a's circuit opens at 4 and is never probed again; b's time goes on; c's second opening finds its timer old
    batches = (
        [("a", i, i * 1.0, 429) for i in range(5)] + [("b", 9, 4.0, 200)], [("b", 10, 250.0, 200), ("c", 1, 250.0, 429)], [("b", 11, 400.0, 200)], [("b", 12, 401.0, 200)],
        [("c", 2 + i, 402.0 + i, 429) for i in range(5)], [("c", 9, 1200.0, 200)],
    )
    for rows in batches:
        spark.createDataFrame(rows, "host string, seq long, at double, status long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("host string, seq long, at double, status long").parquet(f"{tmp_path}/in")
        before = len(found)
        query = stream_circuit_events(stream).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        if rows[0][:2] == ("b", 10):
            assert len(found) == before
    got = [(r.host, r.event, r.seq, r.at) for r in found]
    assert got == [("a", "opened", 4, 4.0), ("a", "closed", None, 304.0), ("c", "opened", 5, 405.0), ("c", "closed", None, 705.0)]


def test_observations_arrive_once(spark, tmp_path):
    df = spark.range(20).select(F.lit("s").alias("site_id"), (F.col("id") % 2).alias("sample_id"), (F.col("id") % 4).cast("string").alias("url"), F.timestamp_seconds(F.col("id")).alias("observed_at"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    drained(stream_observations(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c").start())
    assert spark.table("once").count() == 4


def test_silent_runs_become_stale(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = []
    for k, rows in enumerate(([("a", 10), ("b", 10)], [("a", 1000)], [("c", 9000)], [("c", 9001)])):
        spark.createDataFrame(rows, "run_id string, s long").select("run_id", F.timestamp_seconds("s").alias("heartbeat_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("run_id string, heartbeat_at timestamp").parquet(f"{tmp_path}/in")
        query = stream_stale_runs(stream).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    assert {(r.run_id, r.stale_ms) for r in found} == {("b", 910_000), ("a", 1_900_000)}


def fed(spark, tmp_path, writer, batches):
    """Runs ``writer(stream)`` once for each of some batches of rows."""
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        writer(stream).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()


OBSERVED = "site_id string, sample_id long, url string, observation_id long, http_status int"


def test_stored_observations_are_not_read_again(spark, tmp_path, monkeypatch):
    batches = [[("s", 1, "a", 5, 200), ("s", 1, "a", 4, None), ("s", 2, "a", 6, 404)], [("s", 1, "a", 1, 500), ("s", 1, "b", 7, 200), (None, 1, "a", 8, 200)], [("s", 1, "b", 2, 404), (None, 1, "a", 3, 404)]]
    read = []
    parquet = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **options: read.append(paths) or parquet(self, *paths, **options))
    fed(spark, tmp_path, lambda s: jobs.store_observations(s, f"{tmp_path}/t"), [spark.createDataFrame(b, OBSERVED) for b in batches])
    assert not read
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert {(r.site_id, r.sample_id, r.url, r.observation_id, r.http_status, r.batch) for r in stored.collect()} == {
        ("s", 1, "a", 4, None, 0), ("s", 2, "a", 6, 404, 0), ("s", 1, "b", 7, 200, 1), (None, 1, "a", 8, 200, 1),
    }
    # a new checkpoint knows no keys, so it can't go on with the table
    stream = spark.readStream.schema(OBSERVED).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="another checkpoint"):
        jobs.store_observations(stream, f"{tmp_path}/t").option("checkpointLocation", f"{tmp_path}/other").trigger(availableNow=True).start().awaitTermination()


def test_findings_are_merged_into_a_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "EVERY", 2)
    samples = spark.createDataFrame([("s", f"p{i}", i, 1000) for i in range(5)], "site_id string, pattern_id string, sample_id long, population long")
    rows = [[("s", i % (k + 1), f"u{k}-{i}", 100 * k + i, 404 if i % 3 else 200) for i in range(6 + k)] for k in range(5)]
    schema = "site_id string, sample_id long, url string, observation_id long, http_status int, is_soft_404 boolean"
    frames = [spark.createDataFrame([(*r, False) for r in part], schema) for part in rows]
    fed(spark, tmp_path, lambda s: jobs.refresh_findings(stream_tallies(s), samples, f"{tmp_path}/r"), frames)
    every = stream_tallies(spark.createDataFrame([(*r, False) for part in rows for r in part], schema))
    want = findings_of_tallies(every.withColumnRenamed("n", "hits"), samples)
    tallies, findings = jobs.found(spark, f"{tmp_path}/r", jobs.ddl(every), jobs.ddl(want))

    def told(df):
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    assert told(tallies) == told(every) and told(findings) == told(want)
    # the base before the last one is kept for a batch that is run again; what it covers is gone
    assert jobs._versions(spark, f"{tmp_path}/r/tallies/base", "upto") == [1, 3]
    assert jobs._versions(spark, f"{tmp_path}/r/tallies/log", "batch") == [2, 3, 4]
    log = jobs.Log(spark, f"{tmp_path}/r/tallies", jobs.ddl(every), jobs.TALLY)
    before = told(log.newest())
    again = spark.read.schema(jobs.ddl(every)).parquet(f"{tmp_path}/r/tallies/log/batch=3").drop("bucket").collect()
    log.write(spark.createDataFrame(again, jobs.ddl(every)), 3)
    log.compact(3)
    assert told(log.newest()) == before
