"""Repeated word windows removed by a log-structured fingerprint index.

Documents arrive in batches of rising ids. The index is a list of immutable runs,
each a table bucketed and sorted by fingerprint, so that a new batch is
merge-joined with them without moving them. Fingerprints are hashes of the
7-word windows that are lowest among those of some 13-word window: two documents
that share a 13-word window share its fingerprint, and one in about four places
needs a row. Fingerprints that a batch shares with a run, or that two of its own
documents share, name the windows to verify: their whole 13-word hashes (128
bits) are compared across all documents up to this batch. When there are more
than ``MAX_RUNS`` runs, they are compacted into one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.llm.common import bounded_steps, durable, filter_of, forget, may_hold, parted, release, small_batches, table
from pathsieve.llm.words import run_hashes, run_hashes_at, word_digests

#: Words of a fingerprint; shorter than the window.
GRAM = 7
#: Runs an index keeps before they are compacted.
MAX_RUNS = 3
#: Property of a run's table: what the index held when it was written.
STATE = "pathsieve.fingerprints"


def _steps(texts: list, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, words, text of each window, its place there, its place among the words, its fingerprint) of bounded steps.

    A window's fingerprint is the lowest hash of its grams.
    """
    gram = min(GRAM, window)
    span = window - gram + 1
    for a, b in bounded_steps(texts):
        words, counts = word_digests([(t or "").encode() for t in texts[a:b]])
        n = len(words) - window + 1
        if n <= 0:
            continue
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(b - a), counts)[:n]
        at = np.flatnonzero(ends[owner] - np.arange(n) >= window)  # within one text
        grams = run_hashes(words, gram, 1)
        low = grams[:n].copy()
        for k in range(1, span):
            np.minimum(low, grams[k: k + n], out=low)
        owner = owner[at]
        yield a, words, owner, at - (ends - counts)[owner], at, low[at]


class FingerprintIndex:
    """Runs of fingerprints of the documents seen so far, as Spark tables.

    An index with a name outlives the call and, where the session's catalog does,
    the session: whoever opens that name again goes on with its runs, by the
    window and the buckets they were made with. The newest run says what the
    index holds: how many documents, and the last batch's ids and documents.
    """

    def __init__(self, spark: SparkSession, window: int = 13, name: str | None = None):
        self.spark, self.window = spark, window
        self.name = name or f"fingerprints_{uuid.uuid4().hex}"
        own = re.compile(re.escape(self.name) + r"_(\d+)", re.IGNORECASE)
        made = sorted(int(m[1]) for t in spark.catalog.listTables(pattern=f"{self.name}_*") if (m := own.fullmatch(t.name))) if name else []
        self.runs = [f"{self.name}_{k}" for k in made]
        self.made = made[-1] + 1 if made else 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.state = {"held": 0, "low": None, "top": None, "added": 0}
        if made:
            stored = [r.value for r in spark.sql(f"SHOW TBLPROPERTIES {self.runs[-1]}").collect() if r.key == STATE]
            if not stored:
                raise ValueError(f"{self.runs[-1]} was not finished: drop it and add its batch again")
            self.state = json.loads(stored[0])
            if self.state.pop("window") != window:
                raise ValueError(f"{self.name} was made with another window")
            self.buckets = self.state.pop("buckets")

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").saveAsTable(name)
        state = json.dumps(self.state | {"window": self.window, "buckets": self.buckets})
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{STATE}' = '{state}')")
        return name

    def admit(self, batch: DataFrame, earlier: DataFrame | None) -> None:
        """Takes note of the ids of a batch; an error unless it comes after all the index holds, which ``earlier`` must be.

        Both are frames of one column, id. A batch may end with documents of the
        last one's highest id again, and the last batch may be added once more.
        """
        size = F.count("id")
        low, top, n = batch.agg(F.min("id"), F.max("id"), size).first()
        if not n:
            return
        last = self.state
        again = (low, top, n) == (last["low"], last["top"], last["added"])
        held = last["held"] - last["added"] if again else last["held"]
        if not again and last["top"] is not None and low < last["top"]:
            raise ValueError(f"the index holds ids up to {last['top']}; a batch with id {low} comes too late")
        count, highest = earlier.agg(size, F.max("id")).first() if earlier is not None else (0, None)
        if count != held or (count and highest > low):
            raise ValueError(f"the index holds {held} documents; the earlier texts are {count}, up to id {highest}, for a batch from id {low}")
        self.state = {"held": held + n, "low": low, "top": top, "added": n}

    def add(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Adds a run for the (id, text) of ``texts``; (fingerprints to verify, those of them that older runs hold)."""
        window = self.window

        def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for first, _, owner, _, _, low in _steps(batch.column(1).to_pylist(), window):
                    if len(low):
                        new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
                        yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), pa.array(ids[first + owner[new]])], ["h", "id"])

        rows = texts.mapInArrow(fingerprints, "h long, id long")
        run = self._write(rows.groupBy("h").agg((F.min("id") < F.max("id")).alias("many")))
        new = self.spark.table(run)
        known = None
        for older in self.runs:
            hit = new.join(self.spark.table(older).select("h"), "h", "left_semi").select("h")
            known = hit if known is None else known.unionByName(hit)
        known = durable(known.distinct()) if known is not None else self.spark.createDataFrame([], "h long")
        self.runs.append(run)
        return new.where("many").select("h").unionByName(known), known

    def extend(self, batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        """Adds the (id, text, t) of ``batch``; (id, t, starts) of their windows that start in a document with a smaller id too.

        ``earlier`` are the texts indexed before, whose ids are smaller than all of
        the batch. They are read only where their windows may have a fingerprint
        that the batch shares with an older run.
        """
        hits, known = self.add(batch)
        own = _windows(batch, hits, self.window, True)
        every = own.select("w", "v", "id")
        if earlier is not None and not known.isEmpty():
            every = every.unionByName(_windows(earlier, known, self.window, False).select("w", "v", "id"))
        # stored, so that Spark may split the windows that many documents hold when it joins them
        first = durable(every.groupBy("w", "v").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("w", "v", "lo"))
        later = own.join(first, ["w", "v"]).where("lo < id")
        starts = durable(later.groupBy("id", "t").agg(F.sort_array(F.collect_set("p")).alias("starts")))
        self.compact()
        forget(first, known)
        del own, every, first, later, hits, known
        release(self.spark)
        return starts

    def compact(self) -> None:
        """One run instead of many, when there are more than ``MAX_RUNS``."""
        if len(self.runs) <= MAX_RUNS:
            return
        rows = self.spark.table(self.runs[0]).select("h")
        for run in self.runs[1:]:
            rows = rows.unionByName(self.spark.table(run).select("h"))
        run = self._write(rows.groupBy("h").agg(F.lit(False).alias("many")))
        self.drop()
        self.runs = [run]

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs = []


def _windows(texts: DataFrame, hits: DataFrame, window: int, places: bool) -> DataFrame:
    """(w, v, id, t, p) of the windows whose fingerprint may be among the hits; p = -1 unless ``places``.

    The filter of hits has a fixed size; where it lets too much pass, windows
    that nothing repeats are compared in vain.
    """
    shared = texts.sparkSession.sparkContext.broadcast(filter_of(hits, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for first, words, owner, place, at, low in _steps(batch.column(1).to_pylist(), window):
                may = np.flatnonzero(may_hold(shared.value, low))
                if len(may):
                    w, v = (run_hashes_at(words, at[may], window, 2, column) for column in (0, 1))
                    row = first + owner[may]
                    p = place[may].astype(np.int32) if places else np.full(len(may), -1, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(v.view(np.int64)), pa.array(ids[row]), pa.array(marks[row]), pa.array(p)], ["w", "v", "id", "t", "p"])

    return texts.mapInArrow(run, "w long, v long, id long, t long, p int")


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text, t) of the rows that can repeat something; t is a hash of the text, which tells rows of one id apart."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("t")).where("id is not null and text is not null")


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 13, batches: int = 2) -> DataFrame:
    """(id, t, starts): the windows of each document that also start in a document with a smaller id.

    Rows whose id is null take no part. ``batches`` ranges of ids are indexed one
    after another; the result doesn't depend on their number.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = _keyed(df, id_col, text)
    cuts = texts.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = [None, *sorted(set(cuts or [])), None]
    index, found = FingerprintIndex(spark, window), None
    try:
        for low, high in zip(cuts, cuts[1:]):
            batch = texts if low is None else texts.where(F.col("id") > low)
            batch = batch if high is None else batch.where(F.col("id") <= high)
            starts = index.extend(batch, None if low is None else texts.where(F.col("id") <= low))
            found = starts if found is None else found.unionByName(starts)
    finally:
        index.drop()
    return found


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Whether each of n words lies in one of the windows."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n] > 0


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 13, batches: int = 2, index: FingerprintIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """``df`` with columns n_words, n_removed and kept (the words that stay, joined by one space).

    A word goes if it lies in a window of ``window`` words that also starts in a
    document with a smaller id; windows are judged on the input. Words are runs
    of bytes other than space and \\t\\n\\v\\f\\r, unchanged. A null text has no
    words. Ids are whole numbers or strings of them; others are an
    error. Rows with a null id and rows that share an id don't touch each other.
    Columns of ``df`` named like a new one are replaced. Only texts that may lose
    words are moved to meet their windows.

    With an ``index``, ``df`` is a batch that comes after all it holds: the batch
    is judged against ``earlier`` (the documents of the batches before, as they
    came), added to the index, and the index stays. An id below those it holds,
    and earlier documents that are not as many as it holds, are errors.
    """
    from pyspark.sql import types as T

    new = ["n_words", "n_removed", "kept"]
    rest = df.drop(*new)
    if index is None:
        starts = repeated_windows(df, id_col, text, window, batches)
    else:
        small_batches(df.sparkSession)
        window = index.window
        ids = [None if x is None else x.select(F.col(id_col).cast("long").alias("id")) for x in (df, earlier)]
        index.admit(*ids)
        starts = index.extend(_keyed(df, id_col, text), None if earlier is None else _keyed(earlier, id_col, text))
    kept_columns = rest.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (columns, id, t, text, starts)."""
        for batch in batches:
            texts = batch.column(batch.num_columns - 2).to_pylist()
            places = batch.column(batch.num_columns - 1)
            counts, removed, kept = [], [], []
            for i, whole in enumerate(texts):
                words = (whole or "").encode().split()
                gone = 0
                if places[i].is_valid:
                    at = np.array(places[i].as_py(), np.int64)
                    away = covered(at, window, len(words))
                    gone = int(away.sum())
                    words = [w for w, a in zip(words, away.tolist(), strict=True) if not a]
                counts.append(len(words) + gone)
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*kept_columns, *new])

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return apply(b.append_column("_starts_", pa.nulls(b.num_rows)) for b in batches)

    schema = T.StructType([*(rest.schema[c] for c in kept_columns), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    marked = rest.withColumns({"_id_": F.col(id_col).cast("long"), "_t_": F.xxhash64(text), "_text_": F.col(text).cast("string")})
    may, alone = parted(marked, F.xxhash64("_id_", "_t_"), filter_of(starts.select(F.xxhash64("id", "t").alias("h")), "h"), (unchanged, schema))
    joined = may.join(starts.select(F.col("id").alias("_id_"), F.col("t").alias("_t_"), F.col("starts").alias("_starts_")), ["_id_", "_t_"], "left")
    return joined.select(*kept_columns, "_id_", "_t_", "_text_", "_starts_").mapInArrow(apply, schema).unionByName(alone)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the 13-word windows that earlier documents hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
