"""Jump consistent hashing: rows to shards without a ring table.

Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm" (2014).
The shard of a key depends on the key and the number of shards alone; with one
shard more, a key either stays or goes to the new shard.

Only DataFrame expressions are used. The 64-bit generator of the paper wraps
around, which ANSI arithmetic refuses, so its state is kept as two 32-bit
halves and multiplied in 16-bit pieces that never overflow a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pathsieve.llm.common import table

#: The generator's multiplier in 32-bit halves (fixed values of the algorithm).
MULTIPLIER_HIGH, MULTIPLIER_LOW = divmod(2862933555777941757, 1 << 32)
MASK = (1 << 32) - 1
#: Rows that one slot range may hold before a shard is dealt over more ranges.
ROWS_PER_RANGE = 200_000
#: Ranges a shard is dealt over at least.
LEAST_RANGES = 64
#: Equal rows that a task numbers at most; more are numbered in pieces.
PIECE = 1_000_000


def _low_product(x: Column, c: int) -> Column:
    """x * c for 32-bit x and c, modulo 2**48 at least in the low 32 bits, as a non-negative long."""
    return x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c) + F.shiftleft((F.shiftright(x, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF)), 16)


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    product = _low_product(low, MULTIPLIER_LOW) + F.lit(1)
    carry = F.shiftright(product, 32) + F.shiftright(F.shiftright(low, 16) * F.lit(MULTIPLIER_LOW), 16)
    upper = carry + _low_product(low, MULTIPLIER_HIGH).bitwiseAND(F.lit(MASK)) + _low_product(high, MULTIPLIER_LOW).bitwiseAND(F.lit(MASK))
    return upper.bitwiseAND(F.lit(MASK)), product.bitwiseAND(F.lit(MASK))


def jump_shard(key: Column, shards: int, more: int = 1) -> Column:
    """struct(shard, grown): the shard of a long key among ``shards``, and among ``shards + more``.

    One walk gives both: the jumps of a key don't depend on the number of
    shards, which only says where to stop. A null key counts as 0.
    """
    if shards < 1 or more < 0:
        raise ValueError("there must be a shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    total = shards + more
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(MASK)).alias("low"),
        F.lit(0).cast("long").alias("next"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"),
    )

    def step(state: Column, _: Column) -> Column:
        at = state["next"]
        high, low = _next_state(state["high"], state["low"])
        return F.when(at >= total, state).otherwise(
            F.struct(
                high.alias("high"), low.alias("low"),
                F.floor((at + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long").alias("next"),
                F.when(at < shards, at).otherwise(state["shard"]).alias("shard"), at.alias("grown"),
            )
        )

    # each jump goes up, so there are at most as many as shards
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(total)), start, step)
    return F.struct(walk["shard"].cast("int").alias("shard"), walk["grown"].cast("int").alias("grown"))


def shard(df: DataFrame, key: str, shards: int, *columns: str) -> DataFrame:
    """(key, *columns, shard, slot, grown_shard) of every row of ``df``.

    slot numbers the rows of a shard from 0 without gaps. A shard is never
    sorted in one task: its rows are dealt over ranges by a hash of the row, the
    ranges are counted (shards x ranges rows), and a row's slot is its place in
    its range plus what the ranges before hold. The ranges grow with the input.
    Equal rows are one counted row until they have their slots, however many
    there are; more than ``PIECE`` of them are dealt out to tasks in pieces. They
    get slots of their own, and which of them comes first doesn't show.

    Nulls: a null key counts as 0. An empty table gives an empty result. A key or
    column named shard, slot or grown_shard is left out of the result, for the
    new column of that name.
    """
    given = [key, *columns]
    own = [f"_c{i}" for i in range(len(given))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(given, own, strict=True))).groupBy(*own).agg(F.count("*").alias("_n"))
    hit = jump_shard(F.col(own[0]), shards)
    placed = rows.withColumn("_hit", hit).select(*own, "_n", F.col("_hit.shard").alias("_shard"), F.col("_hit.grown").alias("_grown"))
    total, most = rows.agg(F.sum("_n"), F.max("_n")).first()
    ranges = max(LEAST_RANGES, -(-(total or 0) // (shards * ROWS_PER_RANGE)))
    placed = placed.withColumn("_range", F.pmod(F.xxhash64(*own), F.lit(ranges)).cast("int"))
    counts = placed.groupBy("_shard", "_range").agg(F.sum("_n").alias("_rows"))
    before = counts.select("_shard", "_range", (F.sum("_rows").over(Window.partitionBy("_shard").orderBy("_range")) - F.col("_rows")).alias("_before"))
    within = Window.partitionBy("_shard", "_range").orderBy(*own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = placed.withColumn("_upto", F.sum("_n").over(within)).join(before, ["_shard", "_range"])
    first = first.withColumn("_first", F.col("_before") + F.col("_upto") - F.col("_n")).withColumn("_last", F.col("_before") + F.col("_upto") - 1)
    if (most or 0) > PIECE:
        starts = F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(PIECE).cast("long")))
        many = first.where(F.col("_n") > PIECE).withColumn("_first", starts).withColumn("_last", F.least(F.col("_last"), F.col("_first") + (PIECE - 1)))
        first = first.where(F.col("_n") <= PIECE).unionByName(many.repartition(*own, "_first"))
    slots = first.withColumn("_slot", F.explode(F.sequence("_first", "_last")))
    new = {"shard": "_shard", "slot": "_slot", "grown_shard": "_grown"}
    return slots.select(*(F.col(n).alias(c) for c, n in zip(given, own, strict=True) if c not in new), *(F.col(n).alias(c) for c, n in new.items()))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` into shards 0 to 23 by doc_id (law ``key``)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    return shard(docs, "doc_id", 24, "size", "text_crc32").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
