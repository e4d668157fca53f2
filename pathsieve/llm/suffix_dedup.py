"""Long byte strings that occur more than once, found by suffix sorting.

All texts together are too long to sort in one place. Each ``window``-byte string
is assigned to the lowest hash among its 128-byte strings (its anchor): equal
windows have equal anchors at the same distance, so the windows of one anchor can
be sorted apart from all others. A run of windows with the same anchor is a chunk.
Anchors that occur once are dropped, and equal chunks are sorted once, however
often they occur. What is left are anchors with several different chunks; they are
dealt out into shards, and each shard's suffixes are sorted by external induced
sorting (``suffix_sort``), where neighbours that share ``window`` bytes are
repeats. An anchor with more different chunks than a shard holds is split by
distance and by digests of what its windows have in common, so no task holds all
of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathsieve.llm.common import bounded_steps, durable, filter_of, forget, groups_of, may_hold, parted, release, small_batches, table
from pathsieve.llm.suffix_sort import repeated
from pathsieve.llm.words import _BYTES, mix, powers

#: Bytes of an anchor.
GRAM = 128
#: Windows of a text that are worked on together, and bits that name a place among their anchors.
SEGMENT, PLACE_BITS = 1 << 20, 21
#: Bytes that a shard takes; the windows of a larger anchor are split by digests.
SHARD_BYTES = 1 << 20
#: Neighbouring distances from the anchor whose windows are told apart together at first.
STRIDE = 16


def _chunks(texts: list, window: int) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, offset, bytes, first window, windows, place of the anchor, anchor) of every segment of every text: its runs of windows with one anchor.

    Places count from the offset, where the segment's bytes begin.
    """
    gram = min(GRAM, window)
    span = window - gram + 1
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    for a, b in bounded_steps(texts):
        raws = [(t or "").encode() for t in texts[a:b]]
        for i, whole in enumerate(raws, a):
            for offset in range(0, len(whole) - window + 1, SEGMENT):
                text = whole[offset: offset + SEGMENT + window - 1]
                count = len(text) - window + 1
                raw = np.frombuffer(text, np.uint8)
                power, inverse = powers(len(raw))
                total = np.empty(len(raw) + 1, np.uint64)
                total[0] = 0
                np.cumsum(_BYTES[raw] * power[: len(raw)], out=total[1:])
                n = len(raw) - gram + 1
                grams = mix((total[gram:] - total[:n]) * inverse[:n])
                # the lowest hash of each window, its first place if there are several
                packed = (grams & ~low_bits) | np.arange(n, dtype=np.uint64)
                blocks = -(-n // span)
                grid = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
                grid[:n] = packed
                grid = grid.reshape(blocks, span)
                left = np.minimum.accumulate(grid, axis=1).reshape(-1)
                right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
                low = np.minimum(right[:count], left[span - 1: span - 1 + count])
                place = (low & low_bits).astype(np.int64)
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                yield i, offset, text, first, np.diff(np.r_[first, count]), place[first], grams[place[first]].view(np.int64)


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _by_digest(contents: DataFrame, window: int) -> DataFrame:
    """(c, first, last): runs of windows of chunks (h, c, n, a, raw) that are in another chunk too. ``contents`` is read repeatedly.

    Equal windows lie at the same distance from their anchor. ``STRIDE``
    neighbouring distances are one stretch: its windows all hold the same core,
    so stretches whose core is in no other chunk are done, and so are those that
    are equal wherever their core occurs. Only the rest is looked at window by
    window.
    """
    schema = "c binary, first int, last int, core binary, own binary"

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, c, n, a, raw in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "n", "a", "raw")), strict=True):
                for block in range((a - n + 1) // STRIDE, a // STRIDE + 1):
                    near, far = max(block * STRIDE, a - n + 1), min(block * STRIDE + STRIDE - 1, a)
                    at = a - block * STRIDE
                    core = raw[at: at + max(0, window - STRIDE + 1)]
                    key = h.to_bytes(8, "little", signed=True) + block.to_bytes(4, "little")
                    rows.append((c, a - far, a - near, _digest(key, core), _digest(bytes([near % STRIDE, far % STRIDE]), raw[a - far: a - near + window])))
            kinds = {"c": pa.binary(), "first": pa.int32(), "last": pa.int32(), "core": pa.binary(), "own": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cs, js, ds = [], [], []
            for c, h, a, raw, first, last in zip(*(batch.column(k).to_pylist() for k in ("c", "h", "a", "raw", "first", "last")), strict=True):
                for j in range(first, last + 1):
                    cs.append(c)
                    js.append(j)
                    ds.append(_digest(h.to_bytes(8, "little", signed=True), (a - j).to_bytes(4, "little"), raw[j: j + window]))
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.binary()), pa.array(js, pa.int32()), pa.array(ds, pa.binary())], ["c", "j", "d"])

    each = durable(contents.mapInArrow(stretches, schema))
    cores = each.groupBy("core").agg((F.min("own") == F.max("own")).alias("alike"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    cores = durable(cores.select("core", "alike"))
    shared = durable(each.join(cores, "core").select("c", "first", "last", "alike"))
    forget(each, cores)
    mixed = shared.where("not alike").join(contents, "c").select("c", "h", "a", "raw", "first", "last").mapInArrow(windows, "c binary, j int, d binary")
    mixed = durable(mixed)
    again = durable(mixed.groupBy("d").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("d"))
    single = mixed.join(again, "d").select("c", F.col("j").alias("first"), F.col("j").alias("last"))
    return shared.where("alike").select("c", "first", "last").unionByName(single)


def _merged(found: DataFrame) -> DataFrame:
    """(c, first, last): the same windows in as few runs as can be."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last = None
                for span in spans:
                    if last is not None and span["first"] <= last[2] + 1:
                        last[2] = max(last[2], span["last"])
                    else:
                        last = [c, span["first"], span["last"]]
                        out.append(last)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), *(pa.array([r[k] for r in out], pa.int32()) for k in (1, 2))], ["c", "first", "last"])

    spans = found.groupBy("c").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    return spans.mapInArrow(runs, "c binary, first int, last int")


def repeats(df: DataFrame, text: str = "text", window: int = 400) -> DataFrame:
    """(t, runs): for each text (by its MD5), the runs [first, last] of window starts that occur elsewhere too."""
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(text).cast("string").alias("text")).where(F.octet_length("text") >= window)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for *_, h in _chunks(batch.column(0).to_pylist(), window)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["h"])

    hits = durable(texts.mapInArrow(anchors, "h long").groupBy("h").count().where("count > 1").select("h"))
    several = spark.sparkContext.broadcast(filter_of(hits, "h"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            hs, cs, ts, ss, ns = [], [], [], [], []
            for i, offset, raw, first, count, _, h in _chunks(batch.column(0).to_pylist(), window):
                for k in np.flatnonzero(may_hold(several.value, h)).tolist():
                    s, n = int(first[k]), int(count[k])
                    hs.append(int(h[k]))
                    cs.append(_digest(raw[s: s + n + window - 1]))
                    ts.append(keys[i])
                    ss.append(offset + s)
                    ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(cs, pa.binary()), pa.array(ts, pa.string()), pa.array(ss, pa.int32()), pa.array(ns, pa.int32())], ["h", "c", "t", "s", "n"])

    keyed = texts.withColumn("t", F.md5("text"))
    places = durable(keyed.mapInArrow(chunks, "h long, c binary, t string, s int, n int"))
    alike = durable(places.groupBy("c").agg(F.count("*").alias("times"), F.min("h").alias("h"), F.min("n").alias("n")))
    anchored = durable(alike.groupBy("h").agg(F.count("*").alias("count"), F.sum(F.col("n").cast("long") + window - 1).alias("bytes")).where("count > 1"))
    large = anchored.where(F.col("bytes") > SHARD_BYTES).select("h")
    some_large = not large.isEmpty()
    open_ = spark.sparkContext.broadcast(filter_of(anchored, "h"))
    big = spark.sparkContext.broadcast(filter_of(large, "h"))  # a smaller anchor that it lets through is split as well

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[bytes] = set()
        for batch in batches:
            hs, cs, ns, places_, raws, bigs = [], [], [], [], [], []
            for _, _, raw, first, count, place, h in _chunks(batch.column(0).to_pylist(), window):
                split = may_hold(big.value, h)
                for k in np.flatnonzero(may_hold(open_.value, h)).tolist():
                    s, n = int(first[k]), int(count[k])
                    chunk = raw[s: s + n + window - 1]
                    c = _digest(chunk)
                    if c not in said:
                        if len(said) > 200_000:
                            said.clear()
                        said.add(c)
                        hs.append(int(h[k]))
                        cs.append(c)
                        ns.append(n)
                        places_.append(int(place[k]) - s)
                        raws.append(chunk)
                        bigs.append(bool(split[k]))
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(cs, pa.binary()), pa.array(ns, pa.int32()), pa.array(places_, pa.int32()), pa.array(raws, pa.binary()), pa.array(bigs, pa.bool_())], ["h", "c", "n", "a", "raw", "big"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        size = 0

        def finish() -> pa.RecordBatch:
            cs, firsts, lasts = [], [], []
            for (c, _, _), hit in zip(held, repeated([x[2] for x in held], [x[1] for x in held], window), strict=True):
                edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    cs.append(c)
                    firsts.append(a)
                    lasts.append(b - 1)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(cs, pa.binary()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], ["c", "first", "last"])

        for _, (cs, ns, raws) in groups_of(batches, 1):
            own = sum(map(len, raws))
            if held and size + own > SHARD_BYTES:
                yield finish()
                size = 0
            if len(cs) > 1:
                held += zip(cs, ns, raws, strict=True)
                size += own
        if held:
            yield finish()

    told = texts.mapInArrow(contents, "h long, c binary, n int, a int, raw binary, big boolean")
    # copies of a chunk come from every task; they meet by c, where they are spread, and not in the one task of their anchor
    told = told.dropDuplicates(["c"])
    if some_large:
        told = durable(told)
    shards = told.where("not big").select("h", "c", "n", "raw")
    partly = shards.repartition("h").sortWithinPartitions("h").mapInArrow(sort, "c binary, first int, last int")
    if some_large:
        partly = partly.unionByName(_merged(_by_digest(told.where("big").select("h", "c", "n", "a", "raw"), window)))
    # of a chunk that occurs repeatedly every window does; only one that occurs once depends on the others
    runs = alike.where("times > 1").select("c", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    runs = runs.unionByName(partly.join(alike.where("times = 1").select("c"), "c", "left_semi").select("c", "first", "last"))
    placed = places.join(runs, "c").select("t", (F.col("s") + F.col("first")).alias("first"), (F.col("s") + F.col("last")).alias("last"))
    out = durable(placed.groupBy("t").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs")))
    forget(hits, places, alike, anchored)
    release(spark)
    return out


def dedup(df: DataFrame, text: str = "text", window: int = 400) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans and kept (binary): each text without its repeated bytes.

    A byte goes if a ``window``-byte string that covers it also starts anywhere
    else, in the same text or in another row (a row that repeats a text counts as
    another); overlaps count, and strings are judged on the input. A null text is
    empty; a text shorter than the window stays whole. kept need not be valid
    UTF-8, since spans begin and end at any byte. Columns of ``df`` named like a
    new one are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    rest = df.drop(*new)
    columns = rest.columns
    runs = repeats(df, text, window)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (columns, text, key, runs)."""
        for batch in batches:
            raws, found = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            rows = []
            for whole, spans in zip(raws, found, strict=True):
                raw = (whole or "").encode()
                joined: list[list[int]] = []
                for span in spans or ():
                    a, b = span["first"], span["last"] + window
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(b, joined[-1][1])
                    else:
                        joined.append([a, b])
                edges = [0, *(x for s in joined for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(joined), kept))
            arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *arrays], [*columns, *new])

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return apply(b.append_column("_runs_", pa.nulls(b.num_rows)) for b in batches)

    schema = T.StructType([*(rest.schema[c] for c in columns), *(T.StructField(c, T.LongType()) for c in new[:3]), T.StructField("kept", T.BinaryType())])
    marked = rest.withColumns({"_text_": F.col(text).cast("string"), "_t_": F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    may, alone = parted(marked, F.xxhash64("_t_"), filter_of(runs.select(F.xxhash64("t").alias("h")), "h"), (unchanged, schema))
    joined = may.join(runs.select(F.col("t").alias("_t_"), F.col("runs").alias("_runs_")), "_t_", "left")
    return joined.select(*columns, "_text_", "_t_", "_runs_").mapInArrow(apply, schema).unionByName(alone)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the bytes of repeated 400-byte strings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
