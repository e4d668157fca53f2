"""Set and upsert semantics as DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a shuffle, as they are stored, that a task reads at most where partitions are joined into larger ones; the setting that says so.
TASK_BYTES, ADVISORY = "8m", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@contextmanager
def small_partitions(spark: SparkSession) -> Iterator[None]:
    """What runs inside has tasks of about ``TASK_BYTES``; else there is a task for each core, up to eight times that, whose rows are some ten times as large in memory."""
    before = spark.conf.get(ADVISORY)
    spark.conf.set(ADVISORY, TASK_BYTES)
    try:
        yield
    finally:
        spark.conf.set(ADVISORY, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the folder that ``spark.checkpoint.dir`` names; only a local session without it gets a temporary one."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; only a local session without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix=f"spark-{name}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(*frames: DataFrame) -> None:
    """Deletes the files of checkpointed frames that nothing reads again; any other frame is left alone."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def append_new(new: DataFrame, existing: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` whose key is neither in ``existing`` nor in an earlier new row (by ``order``, else any one). Keys are compared null-safe."""
    if order:
        first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")
    else:
        first = new.dropDuplicates(list(key))
    old = existing.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    condition = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        condition = c if condition is None else condition & c
    return first.join(old, condition, "left_anti")


def upsert_add(existing: DataFrame, new: DataFrame, key: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    both = existing.select(*key, *amounts).unionByName(new.select(*key, *amounts))
    return both.groupBy(*key).agg(*(F.sum(a).alias(a) for a in amounts))


def upsert_replace(existing: DataFrame, new: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of ``new``, and those of ``existing`` whose key ``new`` lacks; the last write of a key within a frame is that with the largest ``order``, or any one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), *([F.desc(order)] if order else [])))).where("_r = 1").drop("_r", "_new")


def distinct_children(urls: DataFrame, key: str = "url") -> DataFrame:
    return urls.dropDuplicates([key])
