import random

import pytest

from pathsieve.llm import substring_dedup
from pathsieve.llm.substring_dedup import FingerprintIndex, dedup


def brute(rows, window):
    first, out = {}, []
    for i, t in rows:
        words = (t or "").encode().split()
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k:k + window])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "window"), [(1, 13), (2, 13), (6, 5)])
def test_against_all_windows(spark, monkeypatch, batches, window):
    monkeypatch.setattr(substring_dedup, "MAX_RUNS", 2)
    pick = random.Random(batches)
    vocabulary = ["w%d" % i for i in range(40)]
    passages = [[pick.choice(vocabulary) for _ in range(pick.randint(10, 40))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(0, 40))]
        for _ in range(pick.randint(0, 3)):
            at = pick.randint(0, len(words))
            words[at:at] = pick.choice(passages)
        rows.append((pick.randint(0, 90), pick.choice([" ", "\n", "  "]).join(words)))
    rows += [(200, ""), (201, None), (202, " \n"), (203, "x " * 20_000), (204, "x " * 30), (None, rows[3][1]), (205, rows[3][1]), (205, rows[3][1])]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)
    made = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup(df, window=window, batches=batches).collect()), key=str)
    assert made == brute(rows, window)
    assert dedup(df.limit(0)).count() == 0


def test_batches_in_separate_calls(spark, monkeypatch):
    """An index that is opened anew for each batch, and compacted on the way."""
    monkeypatch.setattr(substring_dedup, "MAX_RUNS", 1)
    pick = random.Random(12)
    vocabulary = ["w%d" % i for i in range(30)]
    passages = [" ".join(pick.choices(vocabulary, k=20)) for _ in range(4)]
    rows = [(i, " ".join([*pick.choices(vocabulary, k=pick.randint(0, 15)), pick.choice(passages) if i % 3 else "", *pick.choices(vocabulary, k=9)])) for i in range(80)]
    cuts, made, name = [0, 25, 26, 60, 80], [], "fingerprints_of_batches"
    for low, high in zip(cuts, cuts[1:]):
        batch, earlier = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows[low:high], rows[:low]))
        index = FingerprintIndex(spark, name=name)
        assert len(index.runs) == min(1, low)
        made += [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup(batch, index=index, earlier=earlier if low else None).collect()]
    FingerprintIndex(spark, name=name).drop()
    assert FingerprintIndex(spark, name=name).runs == []
    assert sorted(made, key=str) == brute(rows, 13)


def test_what_an_index_refuses(spark):
    """Missing or other earlier texts, ids that come too late, another window; names that begin one another."""
    passage = " ".join(f"w{i}" for i in range(20))
    frame = lambda *rows: spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    first, second = frame((5, passage), (6, None), (None, passage)), frame((7, "so " + passage), (8, "x"))
    key = "spark.sql.shuffle.partitions"
    before, other = spark.conf.get(key), FingerprintIndex(spark, name="refusals_1")
    dedup(frame((1, "y")), index=other).count()
    assert FingerprintIndex(spark, name="refusals").runs == []
    try:
        dedup(first, index=FingerprintIndex(spark, name="refusals")).count()
        index = FingerprintIndex(spark, name="refusals")
        assert index.runs == ["refusals_0"] and index.state["held"] == 2
        for batch, earlier in ((second, None), (second, frame((5, passage))), (second, frame((5, passage), (9, "z"))), (frame((4, passage), (8, "x")), first)):
            with pytest.raises(ValueError):
                dedup(batch, index=FingerprintIndex(spark, name="refusals"), earlier=earlier)
        with pytest.raises(ValueError):
            FingerprintIndex(spark, window=5, name="refusals")
        spark.conf.set(key, "3")
        want = {7: 20, 8: 0}
        # a batch may be added again, when what came of it was lost
        for _ in range(2):
            index = FingerprintIndex(spark, name="refusals")
            assert index.buckets == int(before)
            assert {r.doc_id: r.n_removed for r in dedup(second, index=index, earlier=first).collect()} == want
        assert index.state["held"] == 4 and len(index.runs) == 3
        assert dedup(first.limit(0), index=index, earlier=first).count() == 0
    finally:
        spark.conf.set(key, before)
        FingerprintIndex(spark, name="refusals").drop()
        FingerprintIndex(spark, name="refusals_1").drop()


def test_words_that_collide_in_polynomials(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = ("".join(letters[b] for b in bits) for letters in ("ab", "ba"))
    start = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{start} {x}"), (2, f"{start} {y}"), (3, f"{start} {x}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup(df).collect()} == {1: 0, 2: 0, 3: 13}
