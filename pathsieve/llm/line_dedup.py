"""Lines that many documents share, kept in one of them only.

Lines are exploded with their positions, normalised and hashed; the documents of
each hash are counted, and a document loses the lines whose hash is over the
threshold unless it is the last to hold it. Texts don't travel with their lines:
what remains is cut from the text by the dropped positions, run by run. All of it
is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.llm.common import durable, table

#: Code points of a key that counts, and documents that must hold it.
SHORTEST, DOCUMENTS = 20, 3
#: Stripped at both ends of a line.
BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that are broadcast at most (24 bytes each), and lines of one key that a task of the shuffled join takes while that bound allows.
HOT_KEYS, KEY_LINES = 1 << 16, 20_000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, doc_id: str, text: str, shortest: int) -> DataFrame:
    """(id, print, pos, a, b): lines whose key counts, by two independent 64-bit hashes of the key. print tells rows of one id apart."""
    each = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("print"), F.posexplode(_lines(F.col(f"`{text}`"))).alias("pos", "line"))
    keyed = each.select("id", "print", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= shortest)
    return keyed.select("id", "print", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key", F.char_length("key")).alias("b"))


def shared_keys(lines: DataFrame, documents: int) -> DataFrame:
    """(a, b, holders, last) of the keys that at least ``documents`` ids hold."""
    # lines of one key are counted in each task before they travel
    return lines.groupBy("a", "b").agg(F.count_distinct("id").alias("holders"), F.max("id").alias("last"), F.count("*").alias("lines")).where(F.col("holders") >= documents)


def dropped_positions(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, print, drops): ascending positions that a document loses.

    Keys with more lines than a task should take are broadcast: there can't be
    more than ``HOT_KEYS`` of them, as the limit is the lines of all shared keys
    over ``HOT_KEYS`` at least. The others meet their lines in a shuffled join.
    """
    total = keys.agg(F.sum("lines")).first()[0] or 0
    limit = max(KEY_LINES, -(-total // HOT_KEYS))
    hot = keys.where(F.col("lines") > limit).select("a", "b", "last")
    cold = keys.where(F.col("lines") <= limit).select("a", "b", "last")
    if hot.isEmpty():
        hits = lines.join(cold, ["a", "b"])
    else:
        # lines of hot keys know their last holder here and are dealt out by places of their own
        known = lines.join(F.broadcast(hot.withColumnRenamed("last", "hot")), ["a", "b"], "left")
        place = F.when(F.col("hot").isNull(), F.col("a")).otherwise(F.xxhash64("id", "print", "pos"))
        met = known.withColumns({"a": place, "b": F.when(F.col("hot").isNull(), F.col("b"))}).join(cold, ["a", "b"], "left")
        hits = met.withColumn("last", F.coalesce("hot", "last"))
    return hits.where(F.col("id") < F.col("last")).groupBy("id", "print").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, documents: int = DOCUMENTS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept, the text without the lines it loses.

    A text is split at ``\\n``; null or empty, it is one empty line. A key with at
    least ``shortest`` code points that at least ``documents`` ids hold loses all
    its lines except in the largest of these ids, where all stay. Rows that
    share an id are one document when ids are counted, and each loses its own
    lines. A row with a null id meets no other row and loses nothing. An empty
    table gives an empty one. Columns of ``docs`` named n_lines, n_dropped or
    kept give way to the new ones.
    """
    lines = long_lines(docs, doc_id, text, shortest)
    keys = durable(shared_keys(lines, documents))
    drops = dropped_positions(lines, keys).select(F.col("id").alias("_line_id_"), F.col("print").alias("_line_print_"), F.col("drops").alias("_line_drops_"))
    own = (F.col(f"`{doc_id}`") == F.col("_line_id_")) & (F.xxhash64(f"`{text}`") == F.col("_line_print_"))
    gone = F.coalesce(F.col("_line_drops_"), F.array().cast("array<int>"))
    parts, n = F.col("_line_parts_"), F.size("_line_gone_")
    # what lies between two dropped lines stays; before the first and after the last as well

    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(F.col("_line_gone_"), i - 1) + 1)
        return F.slice(parts, start + 1, F.when(i == n, F.size(parts)).otherwise(F.get(F.col("_line_gone_"), i)) - start)

    kept = F.when(n == 0, F.coalesce(F.col(f"`{text}`"), F.lit(""))).otherwise(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n"))
    new = {"n_lines": F.size(parts).cast("long"), "n_dropped": n.cast("long"), "kept": kept}
    # an id or text of one of these names is read before it gives way
    made = docs.join(drops, own, "left").select("*", _lines(F.col(f"`{text}`")).alias("_line_parts_"), gone.alias("_line_gone_"))
    return made.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new), *(c.alias(k) for k, c in new.items()))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without their shared lines (keys of 20 code points in 3 documents)."""
    made = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
