"""Long ordered logs in pieces: what runs through a key's rows in order is counted piece by piece and carried over.

A key with a third of all rows is still many pieces, and a piece is small. Only
one summary a piece meets the others of its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathsieve.operators.upserts import checkpointed

#: Rows of a piece at most.
PIECE = 8192


def in_pieces(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``piece``, dealt out and sorted by (key, order); pieces ascend in that order and may hold the end of one key and the start of the next.

    The result is a checkpoint, so its tasks go on to read it in order. Nulls
    come first.
    """
    by = [F.col(c).asc_nulls_first() for c in (*key, *order)]
    return checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("piece", F.expr(f"monotonically_increasing_id() div {PIECE}")))


def _met(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left join on (key, piece), null keys included."""
    right = right.select(*(F.col(k).alias(f"_k{i}_") for i, k in enumerate(key)), F.col("piece").alias("_piece_"), *(c for c in right.columns if c not in (*key, "piece")))
    on = F.col("piece") == F.col("_piece_")
    for i, k in enumerate(key):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}_"))
    return left.join(right, on, "left").drop("_piece_", *(f"_k{i}_" for i in range(len(key))))


def running_sum(pieces: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """``pieces`` with the sum of ``value`` over the rows of the key up to each, itself included."""
    rows = pieces.withColumn("_value_", F.coalesce(value, F.lit(0)))
    sums = rows.groupBy(*key, "piece").agg(F.sum("_value_").alias("_own_"))
    before = sums.withColumn("_before_", F.sum("_own_").over(Window.partitionBy(*key).orderBy("piece")) - F.col("_own_")).drop("_own_")
    within = Window.partitionBy(*key, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _met(rows.withColumn(out, F.sum("_value_").over(within)), before, key).withColumn(out, F.col(out) + F.col("_before_")).drop("_value_", "_before_")


def run_lengths(pieces: DataFrame, key: Sequence[str], order: Sequence[str], kind: Column, out: str) -> DataFrame:
    """``pieces`` with the length so far of each row's run of one ``kind``; a null kind ends a run and has the length 0."""
    own = Window.partitionBy(*key, "piece").orderBy(*order)
    rows = pieces.withColumn("_kind_", kind)
    rows = rows.withColumn("_change_", F.when(F.row_number().over(own) == 1, 0).when(F.col("_kind_").eqNullSafe(F.lag("_kind_").over(own)), 0).otherwise(1))
    rows = rows.withColumn("_run_", F.sum("_change_").over(own))
    rows = rows.withColumn(out, F.row_number().over(Window.partitionBy(*key, "piece", "_run_").orderBy(*order)))
    # a piece's first run goes on from the last run of the piece before
    ends = rows.groupBy(*key, "piece", "_run_").agg(F.first("_kind_").alias("kind"), F.count("*").alias("n"))
    ends = ends.groupBy(*key, "piece").agg(
        F.min_by("kind", "_run_").alias("first"), F.max_by("kind", "_run_").alias("last"), F.max_by("n", "_run_").alias("tail"), (F.count("*") == 1).alias("whole"),
    )
    along = Window.partitionBy(*key).orderBy("piece")
    # pieces that are one run, of the kind that the piece before ends with, are links of a chain
    ends = ends.withColumn("_joins_", F.coalesce(F.col("first") == F.lag("last").over(along), F.lit(False)))
    chain = F.sum(F.when(F.col("whole") & F.col("_joins_"), 0).otherwise(1)).over(along)
    length = F.sum("tail").over(Window.partitionBy(*key, "_chain_").orderBy("piece"))
    ends = ends.withColumn("_chain_", chain).withColumn("_length_", length)
    carried = ends.withColumn("_carried_", F.when(F.col("_joins_"), F.lag("_length_").over(along)).otherwise(0)).select(*key, "piece", "_carried_")
    met = _met(rows, carried, key)
    found = F.when(F.col("_kind_").isNull(), 0).otherwise(F.col(out) + F.when(F.col("_run_") == 0, F.col("_carried_")).otherwise(0))
    return met.withColumn(out, found).drop("_kind_", "_change_", "_run_", "_carried_")
