"""The probe log as a stream: idempotent observations, running tallies, refusal circuits and stale runs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pathsieve.operators.estimate import findings_of_tallies
from pathsieve.operators.probes import REASONS, Circuit


KEY = ("site_id", "sample_id", "url")


def stream_observations(observations: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (site, sample, url) once, within the watermark; ``store_observations`` knows no such limit."""
    return observations.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", late).dropDuplicatesWithinWatermark(list(KEY))


def store_observations(observations: DataFrame, path: str, order: str = "observation_id") -> DataStreamWriter:
    """Appends what is new in each micro-batch to the table in ``path``, whenever its key came before; a batch that is run again replaces its own rows.

    The index of keys is the stream's state, so a micro-batch costs what it
    holds, however much was stored before, and the table isn't read. State is
    kept for good; with many keys it belongs into RocksDB. A key's row is the
    first by ``order`` of the micro-batch that brought the key. The table belongs
    to the stream's checkpoint: a new checkpoint needs a new table.
    """
    # the time of a micro-batch, the same when it is run again
    timed = observations.withColumn("_now", F.current_timestamp())
    rest = [c for c in observations.columns if c not in KEY]
    seen = timed.groupBy(*KEY).agg(F.min("_now").alias("_first"), F.max("_now").alias("_last"), F.min_by(F.struct(*rest), F.struct("_now", order)).alias("_row"))

    def append(rows: DataFrame, batch: int) -> None:
        if batch == 0 and set(_versions(rows.sparkSession, path, "batch", whole=False)) - {0}:
            raise ValueError(f"{path} belongs to another checkpoint")
        rows.where("_first = _last").select(*KEY, "_row.*").select(*observations.columns).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return seen.writeStream.outputMode("update").foreachBatch(append)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _folder_of(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str, name: str, whole: bool = True) -> list[int]:
    """The numbers k of the folders ``name=k`` in ``path``, ascending; only those that were written to their end, unless told otherwise."""
    at, fs = _folder_of(spark, path)
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if not whole or fs.exists(_folder_of(spark, f"{p}/_SUCCESS")[0]))


def stream_tallies(observations: DataFrame) -> DataFrame:
    """Running counts by sample, status and soft 404; for update or complete mode."""
    return observations.groupBy("site_id", "sample_id", "http_status", "is_soft_404").agg(F.count("*").alias("n"))


#: Micro-batches after which a log is merged into its base, and buckets of a base and its logs.
EVERY, BUCKETS = 10, 64
TALLY = ("site_id", "sample_id", "http_status", "is_soft_404")
SAMPLE = ("site_id", "sample_id")


class Log:
    """The newest rows of each key, kept as a base and the logs of the micro-batches after it.

    ``path``/base/upto=k holds what micro-batches up to k left, ``path``/log/batch=k
    what batch k brought, both by buckets of the sample. A base is written with
    every ``EVERY``-th batch and the one before it goes with the next, so that a
    batch that is run again finds what it found before.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str]):
        self.spark, self.path, self.schema, self.key = spark, path, f"{schema}, bucket int", key

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={batch}")

    def newest(self, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The newest rows of each key up to a batch, with their ``batch``."""
        base = self._base(batch)
        logs = [k for k in _versions(self.spark, f"{self.path}/log", "batch") if (base is None or k > base) and (batch is None or k <= batch)]
        reader = self.spark.read.schema(f"{self.schema}, batch long")
        parts = [reader.option("basePath", f"{self.path}/log").parquet(*(f"{self.path}/log/batch={k}" for k in logs))] if logs else []
        if base is not None:
            parts.append(self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.path}/base/upto={base}"))
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, batch long").drop("bucket")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return newest(rows if buckets is None else rows.where(F.col("bucket").isin(buckets)), self.key).drop("bucket")

    def _base(self, batch: int | None) -> int | None:
        return max((k for k in _versions(self.spark, f"{self.path}/base", "upto") if batch is None or k < batch), default=None)

    def compact(self, batch: int) -> None:
        """Merges the logs up to ``batch`` into a new base, if there are enough of them."""
        base = self._base(batch)
        if batch - (-1 if base is None else base) < EVERY:
            return
        self.newest(batch).withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/upto={batch}")
        for folder, name in (("log", "batch"), ("base", "upto")):
            for k in _versions(self.spark, f"{self.path}/{folder}", name, whole=False):
                if base is not None and (k <= base if folder == "log" else k < base):
                    at, fs = _folder_of(self.spark, f"{self.path}/{folder}/{name}={k}")
                    fs.delete(at, True)


def _bucket():
    return F.pmod(F.xxhash64(*SAMPLE), F.lit(BUCKETS)).cast("int")


def refresh_findings(tallies: DataFrame, samples: DataFrame, path: str) -> DataStreamWriter:
    """Keeps the logs ``path``/tallies and ``path``/findings: with each micro-batch, the changed counts and new findings of the samples they belong to.

    ``samples`` (site_id, pattern_id, sample_id, population) is a table. What a
    micro-batch reads are the buckets of its samples, in the base and the logs
    since; ``found`` reads the results. A batch that is run again replaces its own
    rows.
    """

    def refresh(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        counts = Log(spark, f"{path}/tallies", ddl(changed), TALLY)
        counts.write(changed, batch)
        # the batch's rows, as they were written
        own = spark.read.schema(f"{ddl(changed)}, bucket int").parquet(f"{path}/tallies/log/batch={batch}")
        touched = own.select(*SAMPLE).distinct()
        buckets = [r.bucket for r in own.select("bucket").distinct().collect()]
        same = _same(touched)
        now = counts.newest(batch, buckets).drop("batch").join(same[0], same[1], "left_semi").withColumnRenamed("n", "hits")
        made = findings_of_tallies(now, samples.join(touched, list(SAMPLE), "left_semi"))
        results = Log(spark, f"{path}/findings", ddl(made), SAMPLE)
        results.write(made, batch)
        counts.compact(batch)
        results.compact(batch)

    return tallies.writeStream.outputMode("update").foreachBatch(refresh)


def _same(touched: DataFrame) -> tuple[DataFrame, object]:
    own = touched.select(*(F.col(c).alias(f"_{c}") for c in SAMPLE))
    return own, F.col("site_id").eqNullSafe(F.col("_site_id")) & F.col("sample_id").eqNullSafe(F.col("_sample_id"))


def found(spark: SparkSession, path: str, tallies: str, findings: str) -> tuple[DataFrame, DataFrame]:
    """(tallies, findings) as the last micro-batch left them; the arguments are their columns as DDL."""
    return Log(spark, f"{path}/tallies", tallies, TALLY).newest().drop("batch"), Log(spark, f"{path}/findings", findings, SAMPLE).newest().drop("batch")


def newest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of the newest batch of each key."""
    last = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return rows.withColumn("_r", F.rank().over(last)).where("_r = 1").drop("_r")


#: Milliseconds by which times are put after the epoch: a time there would count as late from the start.
AFTER_EPOCH = 86_400_000
EVENTS = "host string, event string, seq long, reason string, at double"


class RefusalCircuit(StatefulProcessor):
    """Per host: refusals in a row, and until when the circuit is open; it closes by a timer, whether or not a probe comes.

    A host without refusals in a row and with a closed circuit has no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("circuit", "last int, streak int, until double, open boolean, reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, streak, until, is_open, reason = self.state.get() if self.state.exists() else (0, 0, float("-inf"), False, None)
        circuit, out = Circuit(last, streak, until), []
        # a host's rows of one micro-batch may come in several pieces, none of them in order: 24 bytes of each are held
        parts = [(pdf["at"].to_numpy(float), pdf["seq"].to_numpy("int64"), pdf["status"].fillna(0).to_numpy("int64")) for pdf in rows]
        at, seq, status = (np.concatenate(x) for x in zip(*parts, strict=True))
        for i in np.lexsort((seq, at)):
            if is_open and at[i] >= circuit.until:
                out.append((key[0], "closed", None, reason, circuit.until))
                is_open = False
            if circuit.takes(at[i], int(status[i])):
                is_open, reason = True, REASONS[int(status[i])]
                out.append((key[0], "opened", int(seq[i]), reason, float(at[i])))
        self._keep(circuit, is_open, reason)
        yield _events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            last, streak, until, is_open, reason = self.state.get()
            # a timer of an earlier opening finds the circuit open for longer
            if is_open and math.ceil(until * 1000) + AFTER_EPOCH <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], "closed", None, reason, until))
                self._keep(Circuit(last, streak, until), False, None)
        yield _events(out)

    def _keep(self, circuit: Circuit, is_open: bool, reason: str | None) -> None:
        if is_open:
            self.handle.registerTimer(math.ceil(circuit.until * 1000) + AFTER_EPOCH)
        if is_open or circuit.streak:
            self.state.update((circuit.last, circuit.streak, circuit.until, is_open, reason))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"seq": "Int64"})


def stream_circuit_events(probes: DataFrame, late: str = "1 minute") -> DataFrame:
    """(host, event, seq, reason, at seconds) as circuits open and close: probes (host, seq, at seconds, status), by time and then seq.

    A circuit closes when the first probe after its cooldown comes or the
    watermark, which is ``late`` behind the latest probe of any host, has passed
    the cooldown. Probes later than that are dropped. Times are seconds from any
    zero, negative ones by less than a day.
    """
    timed = probes.select("host", F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), F.col("status").cast("long").alias("status"), F.timestamp_millis(F.floor(F.col("at") * 1000).cast("long") + AFTER_EPOCH).alias("moment"))
    return timed.withWatermark("moment", late).groupBy("host").transformWithStateInPandas(RefusalCircuit(), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def stream_refusal_circuits(probes: DataFrame, late: str = "1 minute") -> DataFrame:
    """(host, opened_seq, reason) as circuits open."""
    return stream_circuit_events(probes, late).where("event = 'opened'").select("host", F.col("seq").alias("opened_seq"), "reason")


def stream_stale_runs(heartbeats: DataFrame, minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """(run_id, stale_ms) of runs without a heartbeat (run_id, heartbeat_at) for so long, by event time.

    A run's state is when it will be stale; each heartbeat moves its timeout.
    """

    def watch(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at = state.get[0]
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "stale_ms": [at]})
            return
        due = max(int(pdf["heartbeat_ms"].max()) for pdf in rows) + minutes * 60_000
        due = max(due, state.get[0]) if state.exists else due
        state.update((due,))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    rows = heartbeats.withWatermark("heartbeat_at", late).withColumn("heartbeat_ms", F.unix_millis("heartbeat_at"))
    return rows.groupBy("run_id").applyInPandasWithState(watch, "run_id string, stale_ms long", "due long", "append", GroupStateTimeout.EventTimeTimeout)
