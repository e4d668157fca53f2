"""Token counts of whole texts by a two-tier lookup, without shuffling pre-tokens.

Tier 1 is a compact table of the lengths (in tokens) of the corpus's frequent
pre-tokens. One pass over all texts finds them: each task keeps a bounded
summary of its words and sends at most ``TASK_WORDS`` counts, and the
``TABLE_WORDS`` most frequent words make the table, so that what is broadcast
has a fixed bound. Tier 2 is a cache in each worker; what neither holds is
encoded by the tokenizer's library and remembered. The table only saves time:
every count is the library's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.llm.common import bounded_steps, small_batches, table

#: Words in the broadcast table, and words that a task reports.
TABLE_WORDS = 32_768
TASK_WORDS = 8_192
#: Longest word, in characters, that the table takes; bounds its bytes.
WORD_CHARS = 64
#: Bytes that a worker's cache of pre-tokens takes before it starts anew, what an entry takes besides its text, and the longest pre-token it keeps.
CACHE_BYTES, ENTRY_BYTES, KEPT_CHARS = 64_000_000, 160, 256


def _tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenCounter:
    """Counts tokens as the library does for one tokenizer file (.json or .model).

    A byte-level BPE tokenizer never merges across pre-tokens, so the count of a
    text is the sum over its pre-tokens. Any other tokenizer, and a text with
    characters that Unicode versions class differently, goes to the library whole.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.frequent = frequent or {}
        self.cache: dict[str, int] = {}
        self.cached = 0
        self.split = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode_all = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        import regex
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        self.encode_all = lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]
        import json
        import unicodedata

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre, added = model.get("pre_tokenizer") or {}, model.get("added_tokens") or []
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            import public_tokenizers

            self.split = regex.compile(public_tokenizers.PATTERN).findall
            self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
            # assigned in one Unicode version only: left to the library
            newer = regex.compile(r"[\p{L}\p{N}\s]")
            self.unsure = frozenset(c for c in map(chr, [*range(0x378, 0xD800), *range(0xE000, 0x33480)]) if unicodedata.category(c) == "Cn" and newer.match(c))

    def count(self, texts: list[str]) -> list[int]:
        if self.split is None:
            return self.encode_all(texts)
        out, missing, parts = [0] * len(texts), {}, []
        whole = []
        frequent, cache = self.frequent, self.cache
        if self.cached > CACHE_BYTES:
            cache.clear()
            self.cached = 0
        for i, text in enumerate(texts):
            if not text.isascii() and not self.unsure.isdisjoint(text):
                whole.append(i)
                parts.append(())
                continue
            pieces = [text]
            if self.added and self.added.search(text):
                pieces = self.added.split(text)
                out[i] = len(pieces) - 1
            tokens = [t for p in pieces for t in self.split(p)] if len(pieces) > 1 else self.split(text)
            parts.append(tokens)
            missing.update((t, 0) for t in set(tokens) if t not in frequent and t not in cache)
        if missing:
            words = list(missing)
            cache.update(zip(words, self.encode_all(words), strict=True))
            self.cached += sum(ENTRY_BYTES + len(w) for w in words)
        for i, tokens in enumerate(parts):
            if tokens:
                get = cache.get
                out[i] += sum([frequent[t] if t in frequent else get(t) for t in tokens])
        for w in [w for w in missing if len(w) > KEPT_CHARS]:
            del cache[w]
            self.cached -= ENTRY_BYTES + len(w)
        for i, n in zip(whole, self.encode_all([texts[i] for i in whole]) if whole else (), strict=True):
            out[i] = n
        return out


_COUNTERS: dict = {}


def frequent_words(df: DataFrame, text: str = "text") -> list[str]:
    """The corpus's most frequent words with the space before them, ``TABLE_WORDS`` at most.

    Every text counts whole. A task's summary drops its rarest words whenever it
    holds four times what it may send, so counts of rare words are estimates;
    they only decide which words the table holds.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            texts = batch.column(0)
            for a, b in bounded_steps(texts.to_pylist(), 4 << 20):
                words = pc.list_flatten(pc.split_pattern(texts.slice(a, b - a).drop_null(), " "))
                found = pc.value_counts(words)
                top = pc.array_sort_indices(found.field("counts"), order="descending")[:TASK_WORDS]
                found = found.take(top)
                seen.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
                if len(seen) > 4 * TASK_WORDS:
                    seen = Counter(dict(seen.most_common(TASK_WORDS)))
        rows = [(w, n) for w, n in seen.most_common(TASK_WORDS) if len(w) <= WORD_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    counts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(summarise, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE_WORDS)
    return [r.word for r in top.select("word").collect()]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``df``, whole texts.

    ``tokenizer`` is a file name of the public tokenizers or a path that exists
    on every executor. No row is shuffled. A null text counts as empty; repeated
    rows are counted each; ids may be null or repeat.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = _tokenizer_path(tokenizer)
    table_of: dict[str, int] = {}
    if path.endswith(".json"):
        counter = TokenCounter(path)
        if counter.split:
            found = {t for w in frequent_words(df, text) for t in counter.split(" " + w)}
            found = sorted(t for t in found if counter.added is None or not counter.added.search(t))
            table_of = dict(zip(found, counter.encode_all(found), strict=True)) if found else {}
    shared = spark.sparkContext.broadcast(table_of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = _tokenizer_path(tokenizer)
        key = (local, shared.id if hasattr(shared, "id") else id(shared.value))
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = TokenCounter(local, shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens: list[int] = []
            for a, b in bounded_steps(texts):
                n_tokens += counter.count(texts[a:b])
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1).cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document."""
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)
