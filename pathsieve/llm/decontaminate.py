"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words: it hashes the selected positions and
ignores the others, so that a substituted word under an ignored position leaves
the hash as it was (Ma, Tromp and Li, 2002). The three masks together miss no
13-word passage in which at most two words were substituted. Seeds of all
benchmark items are joined with those at every position of every document, and
around each hit the item is laid over the document at that offset and compared
word by word.

Only DataFrame expressions are used. Documents' seeds are made, looked up and
verified in one pass, without a shuffle, while the benchmark's seeds are few
enough to broadcast; beyond that both sides are shuffled by seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.llm.common import table

#: Words of a passage, and how many of them must agree.
WINDOW, AGREE = 13, 11
#: Selected positions of each mask.
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 3, 5, 7, 8), (0, 1, 4, 7, 8, 9, 10))
#: Items with fewer words than ``WINDOW`` are sought by all runs of this many words.
SHORT_MASK = (0, 1, 2)
#: Share of the words of such an item that must agree.
SHORT_SHARE = 0.85
#: Benchmark seeds and words that are broadcast at most; a seed takes about 40 bytes and a word 8.
BROADCAST_SEEDS, BROADCAST_WORDS = 1_000_000, 4_000_000


def word_array(text: Column) -> Column:
    """Hashes of the lower-cased words of a text; punctuation and white space divide words. Null has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: Column, at: Column, masks: tuple) -> Column:
    return F.array(*(F.xxhash64(F.lit(k), *(F.get(words, at + p) for p in mask)) for k, mask in enumerate(masks)))


def _agreement(document: Column, item: Column, offset: Column) -> Column:
    """Most words that agree in any passage of the item laid over the document at ``offset``."""
    same = F.transform(item, lambda w, k: F.coalesce((F.get(document, offset + k) == w).cast("int"), F.lit(0)))
    length = F.size(item)
    width = F.least(length, F.lit(WINDOW))
    passages = F.transform(F.sequence(F.lit(1), length - width + 1), lambda s: F.aggregate(F.slice(same, s, width), F.lit(0), lambda a, x: a + x))
    return F.array_max(passages)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, agree, words, doc_word, item_word) of every document that holds a passage of a benchmark item.

    A passage is ``WINDOW`` consecutive words of the item of which ``AGREE`` or
    more stand at the same distances in the document; an item with 3 to 12 words
    must agree in ``SHORT_SHARE`` of them as a whole; items with fewer than three
    words say nothing and are never found. agree is the best passage's count,
    words its length, and the other two an offset at which it lies. One row per
    pair: repeated rows of documents or items add none. Null ids, null and empty
    texts are never found.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), word_array(F.col(text)).alias("item")).where(F.col("item_id").isNotNull() & (F.size("item") >= len(SHORT_MASK)))
    short = items.where(F.size("item") < WINDOW).limit(1).count() > 0
    masks = (*MASKS, SHORT_MASK) if short else MASKS
    spans = [max(m) + 1 for m in masks]
    seeds = items.select("item_id", "item", F.explode(F.sequence(F.lit(0), F.size("item") - min(spans))).alias("q"))
    seeds = seeds.select("item_id", "item", "q", F.posexplode(_seeds(F.col("item"), F.col("q"), masks)).alias("mask", "seed"))
    before = F.when(F.col("q") > 0, F.get(_seeds(F.col("item"), F.col("q") - 1, masks), F.col("mask")))
    fits = F.element_at(F.array(*map(F.lit, spans)), F.col("mask") + 1) + F.col("q") <= F.size("item")
    whole = (F.size("item") >= WINDOW) == (F.col("mask") < len(MASKS))
    seeds = seeds.where(fits & whole).select("item_id", "q", "seed", "mask", before.alias("before"))
    words = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    few = words <= BROADCAST_WORDS and seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS

    def worded(rows: DataFrame) -> DataFrame:
        return rows.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), word_array(F.col(text)).alias("document"))

    # the words stay in the task: seeds refer to them, and only what an item is laid over leaves the look-up
    reach = F.size("document") - min(spans)
    places = worded(docs).select("doc_id", "document", F.explode(F.when(reach >= 0, F.sequence(F.lit(0), reach))).alias("p"))
    places = places.select("doc_id", "document", "p", F.explode(_seeds(F.col("document"), F.col("p"), masks)).alias("seed"))
    offset = F.col("p") - F.col("q")
    if few:
        hits = places.join(F.broadcast(seeds), "seed")
        # of hits in a row, which lie at one offset, the first says it all
        first = F.col("before").isNull() | (F.col("p") == 0) | (F.get(_seeds(F.col("document"), F.col("p") - 1, masks), F.col("mask")) != F.col("before"))
        hits = hits.where(first).join(F.broadcast(items), "item_id")
    else:
        # words meet again only where seeds do
        known = places.select("doc_id", "p", "seed").join(seeds, "seed").select("doc_id", "item_id", offset.alias("p"), F.lit(0).alias("q")).distinct()
        hits = known.join(worded(docs), "doc_id").join(items, "item_id")
    base = F.greatest(offset, F.lit(0))
    hits = hits.select("doc_id", "item_id", "item", offset.alias("offset"), F.slice("document", base + 1, F.size("item")).alias("part"))
    # a generator keeps the comparison, which can't be compiled, out of the look-up
    hits = hits.select("doc_id", "item_id", "offset", F.least(F.size("item"), F.lit(WINDOW)).alias("words"), F.explode(F.array(_agreement(F.col("part"), F.col("item"), F.least(F.col("offset"), F.lit(0))))).alias("agree"))
    enough = F.when(F.col("words") == WINDOW, F.lit(AGREE)).otherwise(F.ceil(F.col("words") * SHORT_SHARE))
    best = hits.where(F.col("agree") >= enough).groupBy("doc_id", "item_id").agg(F.max(F.struct("agree", "words", (-F.col("offset")).alias("back"))).alias("best"))
    offset = -F.col("best.back")
    return best.select("doc_id", "item_id", "best.agree", "best.words", F.greatest(offset, F.lit(0)).alias("doc_word"), F.greatest(-offset, F.lit(0)).alias("item_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose document holds a passage of the benchmark; all columns stay as they are."""
    bad = overlaps(docs, benchmark, doc_id, item_id, text).select(F.col("doc_id").alias("_bad_")).distinct()
    return docs.join(bad, F.col(doc_id) == F.col("_bad_"), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item of which it holds a passage."""
    return overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
