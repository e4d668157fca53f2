"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def forget(*frames: DataFrame) -> None:
    """Deletes the files of ``durable`` frames that nothing reads again; any other frame is left alone."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Links of one node that a task of a join takes at most, about, while no more than ``HOT_NODES`` nodes have more; else as many as leave no more such nodes.
HOT_NODE, HOT_NODES = 20_000, 65_536


def bounded_steps(texts: Iterable, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` characters together."""
    begin = size = at = 0
    for at, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield begin, at
            begin, size = at, 0
        size += n + 1
    if size:
        yield begin, at + 1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected
    Components in MapReduce and Beyond" (2014): each is one aggregation and one
    join on node keys, and the number of rounds grows with the logarithm of the
    longest path. The root of a large component has a link to each of its nodes;
    the join deals the links of such a node out to tasks of ``HOT_NODE`` links,
    or a fixed share of all links where these are very many, so that the nodes
    it broadcasts are ``HOT_NODES`` at most. Self links and null ends are ignored; repeated links count once.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    # every link points from the larger to the smaller end
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sums, links = None, e.count()
    while True:
        # n links have 2 n ends, so at most 2 n / most nodes have more than ``most`` of them
        most = max(HOT_NODE, -(-2 * links // HOT_NODES))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.ceil(F.count("*") / most).cast("int").alias("parts"))
        hot = F.broadcast(low.where("parts > 1").select("u", "parts"))
        part = F.coalesce(F.pmod(F.xxhash64("v"), "parts"), F.lit(0)).cast("int")
        dealt = both.where("v > u").join(hot, "u", "left").select("u", "v", part.alias("part"))
        low = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        large = dealt.join(low, ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        before, e = e, durable(
            star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        forget(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sums:
            break
        sums, links = now, now[0]
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


#: Bits of a filter at most (8 MB when broadcast), and bits an entry gets while there is room.
FILTER_BITS, ENTRY_BITS = 1 << 26, 12
_FILTER_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def filter_of(hashes: DataFrame, column: str) -> np.ndarray:
    """Bloom filter of a column of 64-bit hashes, as 64-bit words.

    It only spares work: whoever asks must be able to do without it. Its size
    has a fixed bound; with more entries it fills up and passes more and more.
    At most ``FILTER_BITS / 64`` rows reach the driver, as Arrow columns of 16 bytes
    a row; as rows of Python they would be some hundred bytes each.
    """
    n = hashes.count()
    bits = 1 << 10
    while bits < min(FILTER_BITS, n * ENTRY_BITS):
        bits *= 2
    shift = 64 - (bits.bit_length() - 1)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for salt in _FILTER_SALTS:
                at = (x * np.uint64(salt)) >> np.uint64(shift)
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some].view(np.int64))], ["word", "bits"])

    found = hashes.select(F.col(column).cast("long")).mapInArrow(positions, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash."""
    shift = np.uint64(64 - ((len(words) * 64).bit_length() - 1))
    x = hashes.view(np.uint64)
    out = np.ones(len(x), bool)
    for salt in _FILTER_SALTS:
        at = (x * np.uint64(salt)) >> shift
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return out


def parted(df: DataFrame, hashes: Column, words: np.ndarray, alone) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: the rows whose hash a filter may hold, as they are, and ``alone`` of the others' batches.

    ``alone`` is (function on batches, schema of its result). Each side is one
    pass of its own, so that a task needs one Python worker.
    """
    shared = df.sparkSession.sparkContext.broadcast(words)
    run, schema = alone

    def only(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            held = may_hold(shared.value, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64))
            yield batch.select(list(range(n))).filter(pa.array(held if wanted else ~held))

    marked = df.withColumn("_hash_", hashes)
    return marked.mapInArrow(lambda batches: only(batches, True), df.schema), marked.mapInArrow(lambda batches: run(only(batches, False)), schema)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of whole texts that travel to Python at once at most; texts can be long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to ``BATCH_ROWS``, for frames that carry whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of each run of rows that agree in their first ``keys`` columns."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        own = list(zip(*columns[:keys], strict=True))
        at = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i] != own[at]:
                part = [c[at:i] for c in columns[keys:]]
                if own[at] == key:
                    for a, b in zip(held, part, strict=True):
                        a.extend(b)
                else:
                    if key is not None:
                        yield key, held
                    key, held = own[at], part
                at = i
    if key is not None:
        yield key, held


def ranked(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` with index, a row's place from 0 among the rows of its key, and total, their number. Nulls come first and are a key of their own.

    The rows are dealt over ranges of (key, order), so that no task holds a whole
    key; a range adds what the ranges before it hold of the same key. Equal rows
    take any places among themselves. ``df`` is read twice: ranges are sampled.
    """
    by = [F.col(c).asc_nulls_first() for c in (*key, *order)]
    placed = durable(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at_", F.monotonically_increasing_id()))
    piece = F.shiftright("_at_", 33)
    counts = placed.groupBy(*key, piece.alias("_piece_")).agg(F.min("_at_").alias("_first_"), F.count("*").alias("_n_"))
    # a key has one row here for each range that holds some of it
    own = Window.partitionBy(*key)
    before = F.sum("_n_").over(own.orderBy("_piece_")) - F.col("_n_")
    starts = counts.select(*(F.col(c).alias(f"_own_{i}_") for i, c in enumerate(key)), "_piece_", (before - F.col("_first_")).alias("_shift_"), F.sum("_n_").over(own).alias("total"))
    met = piece == F.col("_piece_")
    for i, c in enumerate(key):
        met &= F.col(c).eqNullSafe(F.col(f"_own_{i}_"))
    return placed.join(starts, met).select(*df.columns, (F.col("_at_") + F.col("_shift_")).alias("index"), "total")
