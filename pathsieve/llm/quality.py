"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

A text is the set of its n-grams: byte trigrams, n-grams of character classes
(runs of lower case, upper case, digits, accented letters; punctuation as
itself) and n-grams of "this word repeats the one before". Each indicator is
scaled by the log ratio of its counts in good and bad texts, counted over all
labelled training rows, and a linear hinge-loss model is fitted on the scaled
vectors by dual coordinate descent (Hsieh et al., 2008) over a bounded sample of
labelled rows. A logistic curve turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.llm.common import bounded_steps, small_batches, table

#: Indicators, after hashing.
BUCKETS = 1 << 17
#: Labelled rows of each class that the hinge-loss model is fitted on, at most.
FIT_ROWS = 3000
#: Label rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 500_000
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 40

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("a"):ord("z") + 1] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")  # accented letters count as letters
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(values: np.ndarray, salt: int) -> np.ndarray:
    return ((values + np.uint64(salt)) * _MIX >> np.uint64(64 - 17)).astype(np.int64)


def _grams(values: np.ndarray, n: int) -> np.ndarray:
    out = values[: len(values) - n + 1]
    for k in range(1, n):
        out = out * np.uint64(0x100000001B3) + values[k: len(values) - n + 1 + k]
    return out


def indicators(text: str | None) -> np.ndarray:
    """Sorted buckets of the n-grams of a whole text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    parts = [_bucket(_grams(raw.astype(np.uint64), 3), 1)] if len(raw) >= 3 else []
    kinds = _CLASS[raw]
    kinds = kinds[np.r_[True, kinds[1:] != kinds[:-1]]]
    parts += [_bucket(_grams(kinds, n), n * 1000) for n in (2, 4, 6) if len(kinds) >= n]
    raw = raw[int(np.argmin(_WHITE[raw])):]  # words begin at once
    white = _WHITE[raw]
    if not white.all():
        starts = np.flatnonzero(~white & np.r_[True, white[:-1]])
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(place.max()) + 1, 0x100000001B3, np.uint64))
            weighted = np.where(white, 0, (raw.astype(np.uint64) + np.uint64(1)) * powers[place])
        words = np.add.reduceat(weighted, starts)
        same = np.r_[False, words[1:] == words[:-1]].astype(np.uint64) + np.uint64(1)
        parts += [_bucket(_grams(same, n), n * 100_000) for n in (1, 2, 4) if len(same) >= n]
    seen = np.zeros(BUCKETS, bool)
    for p in parts:
        seen[p] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = weights[indicators] scaled by 1/|x| + bias."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        x = self.ratio[found]
        length = float(np.sqrt(x @ x)) or 1.0
        return float(self.weights[found] @ x) / length + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(indicators(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> Model:
    """Dual coordinate descent on the rows' scaled indicators, then a logistic curve over their margins."""
    n = len(rows)
    if not n or (y > 0).all() or (y < 0).all():
        share = 0.5 if not n else float((y > 0).mean())
        return Model(ratio, np.zeros(BUCKETS), 0.0, 0.0, 9.0 * (share - 0.5))
    vectors = []
    for found in rows:
        x = ratio[found]
        vectors.append(x / (np.sqrt(x @ x) or 1.0))
    square = np.array([x @ x for x in vectors]) + 1.0  # the bias is a constant indicator
    cost = np.where(y > 0, COST * n / (2 * (y > 0).sum()), COST * n / (2 * (y < 0).sum()))
    w, b, alpha, order = np.zeros(BUCKETS), 0.0, np.zeros(n), np.random.default_rng(7)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in order.permutation(n):
            found, x = rows[i], vectors[i]
            slack = y[i] * (w[found] @ x + b) - 1
            change = min(max(alpha[i] - slack / square[i], 0.0), cost[i]) - alpha[i]
            if change:
                worst = max(worst, abs(change))
                alpha[i] += change
                w[found] += change * y[i] * x
                b += change * y[i]
        if worst < 1e-3:
            break
    margins = np.array([w[f] @ x + b for f, x in zip(rows, vectors, strict=True)])
    # Platt's curve by Newton's method, with his smoothed targets
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * margins + ab[1], -500, 500)))
        gradient = np.array([((p - target) * margins).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        hessian = np.array([[(v * margins**2).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        ab = ab - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(ratio, w, float(b), float(max(ab[0], 0.0)), float(ab[1]))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str) -> DataFrame:
    """(text, good) of the labelled rows; labels go to the texts while they are few."""
    few = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(labels) if few else labels, "id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", text: str = "text") -> Model:
    """Learns from all rows of ``labels`` (id, 0/1) whose id is in ``docs``.

    Counts of n-grams cover every labelled row: a task sends one row for each
    indicator it saw, and at most ``BUCKETS`` rows of sums reach the driver. The
    hinge-loss model takes ``FIT_ROWS`` rows of each class, those with the lowest
    hash of their id, and is fitted in one task. Null ids or labels are left
    out, an id labelled more than once counts once with its highest label; of rows
    that share an id, all are counted and one is fitted on;
    without labels of both classes every text gets the same score.
    """
    small_batches(docs.sparkSession)
    labels = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("good")).where("id is not null and good is not null")
    labels = labels.groupBy("id").agg(F.max("good").alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text_, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[int(good > 0)][indicators(text_)] += 1
        seen = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(sums[0][seen]), pa.array(sums[1][seen])], ["bucket", "bad", "good"])

    rows = _labelled(docs, labels, id_col, text).select("text", "good")
    counts = rows.mapInArrow(count, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    p, q = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    p[counts.bucket] += counts.good
    q[counts.bucket] += counts.bad
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    chosen = None
    for good in (0, 1):
        part = labels.where(F.col("good") == good).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = [(x, g) for pdf in batches for x, g in zip(pdf["found"], pdf["good"], strict=True)]
        data.sort(key=lambda d: (d[1], len(d[0]), d[0].tobytes()))  # the order of arrival doesn't matter
        m = fit_hinge([np.asarray(x, np.int64) for x, _ in data], np.array([1.0 if g > 0 else -1.0 for _, g in data]), shared.value)
        yield pd.DataFrame({"weights": [m.weights.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, good = batch.column(0).to_pylist(), batch.column(1)
            for a, b in bounded_steps(texts):
                yield pa.RecordBatch.from_arrays([pa.array([indicators(t).astype(np.int32) for t in texts[a:b]], pa.list_(pa.int32())), good.slice(a, b - a)], ["found", "good"])

    sample = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "good")).alias("row"))
    sample = sample.select("row.text", "row.good").mapInArrow(featurise, "found array<int>, good int").repartition(1)
    row = sample.mapInPandas(train, "weights binary, bias double, slope double, shift double").first()
    return Model(ratio, np.frombuffer(bytes(row.weights)).copy(), row.bias, row.slope, row.shift)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, 0 (bad) to 1 (good). Null counts as empty, which gets the score of the bias."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made = [own.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.float64())], [*kept, out])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())])
    return docs.select(*kept, F.col(text).cast("string").alias("_text_")).mapInArrow(run, schema)


def held_out(id_col: str) -> Column:
    """Whether a row's label is kept from training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_on(spark: SparkSession, sf_dir: str) -> Model:
    """The model of a folder's documents and training labels."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole document."""
    model = fit_on(spark, sf_dir)
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
