import random

import numpy as np

from pathsieve.llm.quality import BUCKETS, COST, SMOOTHING, fit, indicators, score


def test_learns_and_scores_every_row(spark):
    pick = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(pick.choices("aeinorst", k=pick.randint(2, 7))) for _ in range(60)]
        good = i % 4 != 0
        rows.append((i, " ".join(words) if good else " ".join(w + pick.choice(["***", "###"]) for w in words), 1.0))
        labels.append((i, int(good)))
    rows += [(1000, "", 1.0), (1001, None, 1.0), (1002, " \n", 1.0), (1003, "x" * 300_000, 1.0), (None, "abc", 1.0), (5, rows[5][1], 1.0)]
    labels += [(5, 1), (None, 1), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = fit(docs, known.where("doc_id % 5 <> 0 or doc_id is null"))
    made = score(docs, model).collect()
    assert len(made) == len(rows) and all(0 <= r.score <= 1 for r in made)
    truth = dict(labels)
    held = [(r.score >= 0.3, truth[r.doc_id]) for r in made if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0]
    assert np.mean([a == bool(b) for a, b in held]) > 0.97
    again = fit(docs.repartition(7), known.where("doc_id % 5 <> 0 or doc_id is null"))
    assert np.allclose(again.weights, model.weights)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score(docs, fit(docs, none)).collect()} == {0.5}
    assert score(docs.limit(0), fit(docs.limit(0), none)).count() == 0


def test_indicators_are_sets_of_whole_texts():
    assert len(indicators("")) == 0 and len(indicators(None)) == 0
    long = indicators("ab " * 50_000 + "###")
    assert len(long) == len(set(long)) and long.max() < BUCKETS
    assert not np.array_equal(long, indicators("ab " * 50_000))


def test_ratios_and_weights_against_brute_force(spark):
    """The ratios are plain counts, and no other weights have a lower hinge loss."""
    pick = random.Random(5)
    rows = [(i, " ".join("".join(pick.choices("abcd", k=3)) + ("!" if i % 3 == 0 and pick.random() < 0.6 else "") for _ in range(12)), int(i % 3 > 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, "other text of the same id")] * 40, "doc_id long, text string")
    model = fit(docs.repartition(5), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    good, bad = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for i, t, y in rows + [(1, "other text of the same id", 1)] * 40:
        (good if y else bad)[indicators(t)] += 1
    assert np.allclose(model.ratio, np.log((good / good.sum()) / (bad / bad.sum())))

    def loss(w, b):
        total = (w @ w + b * b) / 2
        for i, t, y in rows:
            if i != 1:  # which of its rows is fitted on is another matter
                x = np.zeros(BUCKETS)
                x[indicators(t)] = model.ratio[indicators(t)]
                sign = 1 if y else -1
                cost = COST * 90 / (2 * sum(r[2] == y for r in rows))
                total += cost * max(0.0, 1 - sign * (w @ x / np.sqrt(x @ x) + b))
        return total

    least, around = loss(model.weights, model.bias), np.random.default_rng(2)
    used = np.flatnonzero(model.weights)
    for size in (0.01, 0.1):
        for _ in range(20):
            w = model.weights.copy()
            w[used] += size * around.standard_normal(len(used)) / np.sqrt(len(used))
            assert loss(w, model.bias + size * around.standard_normal() / 10) > least - 0.05
