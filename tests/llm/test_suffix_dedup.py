import collections
import random

import numpy as np
import pytest

from pathsieve.llm import suffix_dedup, suffix_sort
from pathsieve.llm.suffix_dedup import dedup
from pathsieve.llm.suffix_sort import repeated


@pytest.mark.parametrize(("memory", "piece"), [(0, 3), (50, 7), (8_000_000, 1 << 17)])
def test_sorting_finds_every_repeat(monkeypatch, memory, piece):
    monkeypatch.setattr(suffix_sort, "MEMORY", memory)
    monkeypatch.setattr(suffix_sort, "PIECE", piece)
    for seed in range(60):
        pick = random.Random(seed)
        window, alphabet = pick.choice([3, 8, 9, 12, 20]), bytes(range(pick.choice([1, 2, 3, 256])))
        chunks = [bytes(pick.choices(alphabet, k=pick.randint(window, 60))) for _ in range(pick.randint(1, 8))]
        for _ in range(3):
            chunks.append(bytes(pick.choices(alphabet, k=3)) + pick.choice(chunks)[: pick.randint(window, 60)] + bytes(pick.choices(alphabet, k=window)))
        starts = [len(c) - window + 1 for c in chunks]
        seen = collections.Counter(c[i:i + window] for c, n in zip(chunks, starts) for i in range(n))
        assert [x.tolist() for x in repeated(chunks, starts, window)] == [[seen[c[i:i + window]] > 1 for i in range(n)] for c, n in zip(chunks, starts)]


@pytest.mark.parametrize(("memory", "piece"), [(100, 16), (8_000_000, 1 << 17)])
def test_order_and_common_prefixes(monkeypatch, memory, piece):
    """A shard of many times the queues' memory: the order of all suffixes, and what neighbours have in common."""
    monkeypatch.setattr(suffix_sort, "MEMORY", memory)
    monkeypatch.setattr(suffix_sort, "PIECE", piece)
    for seed in range(12):
        pick = random.Random(seed)
        depth = pick.choice([5, 30, 64])
        text = np.array([x for _ in range(30) for x in [*pick.choices(range(1, pick.choice([2, 3, 9, 257])), k=pick.randint(1, 90)), 0]], np.int16)
        blocks = list(suffix_sort.sorted_suffixes(text, depth))
        order, common = (np.concatenate(x).tolist() for x in zip(*blocks, strict=True))
        # the end of the text comes after every symbol
        keys = {i: tuple([*text[i:i + depth].tolist(), *[999] * (i + depth - len(text))]) for i in range(len(text) - 1)}
        assert sorted(order) == sorted(keys)
        assert all(keys[a] >= keys[b] for a, b in zip(order, order[1:]))
        for a, b, n in zip(order, order[1:], common[1:]):
            same = next((k for k, (x, y) in enumerate(zip(keys[a], keys[b])) if x != y), depth)
            assert min(n, depth) == same, (keys[a], keys[b], n)


@pytest.mark.parametrize("piece", [3, 1 << 17])
def test_suffixes_are_compared_by_words(monkeypatch, piece):
    """Seven symbols at once, to the end wherever a word of seven meets it, and no further than the depth."""
    monkeypatch.setattr(suffix_sort, "PIECE", piece)
    for n in range(1, 24):
        text = np.array([*[2] * n, 0, *[2] * n, 256, 0, *[2] * n, 0], np.int16)
        words = suffix_sort._words(text)
        a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(len(text)), np.arange(len(text))))
        a, b = a[a != b], b[a != b]
        for depth in (1, 7, 20, 400):
            want = [next((k for k, (x, y) in enumerate(zip(text[i:i + depth], text[j:j + depth])) if x != y), min(depth, len(text) - max(i, j))) for i, j in zip(a, b)]
            assert suffix_sort._common(words, a, b, depth).tolist() == want


def brute(texts, window):
    seen = collections.Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("shard", "gram", "segment"), [(1 << 20, 128, 1 << 20), (200, 16, 1 << 20), (200, 10, 37), (0, 1, 100)])
def test_against_all_windows(spark, monkeypatch, shard, gram, segment):
    for name, value in (("SHARD_BYTES", shard), ("GRAM", gram), ("SEGMENT", segment)):
        monkeypatch.setattr(suffix_dedup, name, value)
    pick = random.Random(shard)
    passages = ["".join(pick.choices("abcdé ", k=pick.randint(30, 90))) for _ in range(5)]
    texts = []
    for _ in range(80):
        t = "".join(pick.choices("abcdefghijkl é\n", k=pick.randint(0, 120)))
        for _ in range(pick.randint(0, 2)):
            at = pick.randint(0, len(t))
            t = t[:at] + pick.choice(passages)[pick.randint(0, 10):] + t[at:]
        texts.append(t)
    texts += ["", None, "x" * 5000, texts[3], texts[3], "short"]
    df = spark.createDataFrame([(i // 2, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    made = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup(df, window=40).collect())
    assert made == brute([(t or "").encode() for t in texts], 40)
    assert dedup(df.limit(0)).count() == 0


def test_one_anchor_never_fills_a_task(spark, monkeypatch, tmp_path):
    """A phrase in every text, in different surroundings: no shard that is sorted exceeds its bytes."""
    sort = suffix_dedup.repeated

    def bounded(chunks, starts, window):
        if sum(map(len, chunks)) > 2000:
            raise ValueError("a shard is too large")
        return sort(chunks, starts, window)

    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "GRAM", 32)
    monkeypatch.setattr(suffix_dedup, "repeated", bounded)
    pick = random.Random(3)
    phrase = "".join(pick.choices("abcdefghijkl ", k=36))
    around = ["".join(pick.choices("abcdefghijkl ", k=30)) for _ in range(4)]
    texts = ["".join(pick.choices("mnopqrstuv ", k=60)) + pick.choice(around)[pick.randint(0, 20):] + phrase + "".join(pick.choices("mnopqrstuv ", k=60)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup(df, window=40).collect())
    assert made == brute([t.encode() for t in texts], 40)


@pytest.mark.parametrize(("shard", "times"), [(1 << 20, 1), (0, None)])
def test_copies_never_meet_in_the_task_of_their_anchor(spark, monkeypatch, shard, times):
    """Near copies in every partition: each chunk reaches the task that sorts its anchor once, if it isn't split, however many copies there are."""
    pick = random.Random(5)
    base = "".join(pick.choices("abcdefghijkl ", k=1500))
    near = [base[:at] + "#" + base[at + 1:] for at in range(100, 1500, 100)]
    texts = near * 8 + [base[300:900]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    kind, most = type(df), []
    real = kind.sortWithinPartitions

    def counted(self, *cols, **more):
        most.append(self.groupBy("h", "c").count().agg({"count": "max"}).first()[0])
        return real(self, *cols, **more)

    monkeypatch.setattr(kind, "sortWithinPartitions", counted)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    made = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup(df).collect())
    assert made == brute([t.encode() for t in texts], 400)
    assert most == [times]
