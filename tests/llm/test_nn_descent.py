import numpy as np
import pytest

from pathsieve.llm import nn_descent
from pathsieve.llm.nn_descent import near_duplicates


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    random = np.random.default_rng(block)
    centers = random.standard_normal((150, 16))
    rows = [c + random.standard_normal(16) * 0.02 * s for c in centers for s in range(random.integers(1, 4))]
    rows += [centers[0] + random.standard_normal(16) * 0.1 for _ in range(60)] + [centers[1] * x for x in (1.0, 2.0, 1.0, 1.0)]
    rows += [centers[2] + random.standard_normal(16) * 0.3 for _ in range(40)]
    vectors = [(i, [float(x) for x in v], "x") for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0]]
    vectors += [(10_000 + i, v, "y") for i, v in enumerate(odd)] + [(None, [1.0] * 16, "z")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, v string").repartition(3)
    x = np.array([v for _, v, t in vectors if t == "x"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        low = np.array([min([root[i], *root[near[i]]]) for i in range(len(x))])
        if (low == root).all():
            break
        root = low
    made = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert len(made) == len(vectors)
    found = sum(made[i].n_links for i in range(len(x)))
    assert found <= near.sum() and found >= 0.95 * near.sum()
    assert np.mean([made[i].component_id == root[i] and made[i].n_links == near[i].sum() for i in range(len(x))]) > 0.95
    assert all(made[i].kept == (made[i].component_id == i) for i in range(len(x)))
    for i in range(len(odd)):
        assert (made[10_000 + i].n_links, made[10_000 + i].component_id, made[10_000 + i].kept) == (0, 10_000 + i, True)
    assert (made[None].n_links, made[None].component_id) == (0, None)


def test_nothing_to_link(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(df).count() == 0


@pytest.mark.parametrize("tile", [1024, 2])
def test_links_between_groups_with_full_lists(spark, monkeypatch, tile):
    monkeypatch.setattr(nn_descent, "TILE", tile, raising=False)
    random = np.random.default_rng(7)
    q = np.linalg.qr(random.standard_normal((64, 64)))[0]
    halves = [q[0], 0.945 * q[0] + np.sqrt(1 - 0.945**2) * q[1]]
    rows = [h + random.standard_normal(64) * 0.005 for h in halves for _ in range(20)] + [q[2] + random.standard_normal(64) * 0.02 for _ in range(400)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    assert near[:40, :40].all() and not near[:40, 40:].any() and near[40:, 40:].all()
    made = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert [(made[i].n_links, made[i].component_id) for i in range(440)] == [(39, 0)] * 40 + [(399, 40)] * 400
    # the audit sees links that are missing in small groups, whatever a large one weighs
    nodes = nn_descent.nodes_of(df, "vec_id", "embedding")
    links = spark.createDataFrame([(i, 19 if i < 40 else 399) for i in range(440)], "id long, links long")
    roots = spark.createDataFrame([(i, 0 if i < 20 else 20 if i < 40 else 40) for i in range(440)], "id long, root long")
    assert nn_descent.audit(nodes, links, roots, 0.9) < 0.95


def test_searches_that_miss_end_in_a_whole_comparison(spark, monkeypatch):
    """With lists of one neighbour and no audit to please, every link and component is still found."""
    monkeypatch.setattr(nn_descent, "RECALL", 2.0)
    monkeypatch.setattr(nn_descent, "REPEATS", 0)
    monkeypatch.setattr(nn_descent, "NEIGHBOURS", 1)
    monkeypatch.setattr(nn_descent, "ROUNDS", 0)
    monkeypatch.setattr(nn_descent, "BLOCK", 8)
    random = np.random.default_rng(11)
    rows = np.concatenate([c + random.standard_normal((random.integers(1, 12), 8)) * 0.12 for c in random.standard_normal((40, 8))])
    near = (unit := rows / np.linalg.norm(rows, axis=1)[:, None]) @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        root = np.array([min([root[i], *root[near[i]]]) for i in range(len(rows))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    made = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert [(made[i].n_links, made[i].component_id) for i in range(len(rows))] == [(near[i].sum(), root[i]) for i in range(len(rows))]


def test_lengths_of_any_size(spark):
    rows = [[1e200, 1.0], [1e200, 2.0], [1e-200, 0.0], [2e-200, 0.0], [5e-324, 0.0], [0.0, 1e300]]
    made = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    assert made == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 0}
