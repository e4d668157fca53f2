import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pathsieve.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    """rows of (key, at, leaf, changed): what ``manifest`` says of each, from whole trees."""
    trees, found = {}, []
    for key in sorted({r[0] for r in rows}, key=lambda k: (k is not None, (k or "").encode())):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        trees[key] = (own, climb([r[2] for r in own]))
    over = climb([levels[-1][0] for _, levels in trees.values()])
    for k, (key, (own, levels)) in enumerate(trees.items()):
        for i, (_, at, digest, node) in enumerate(own):
            siblings = []
            for tree, place in ((levels, i), (over, k)):
                for level in tree[:-1]:
                    run = level[place // 8 * 8 : place // 8 * 8 + 8]
                    slot = place % 8
                    siblings += run[:slot] + run[slot + 1 :]
                    node = h(*run[:slot], node, *run[slot + 1 :])
                    place //= 8
            found.append((key, at, digest, levels[-1][0], over[-1][0], h(*siblings), node))
    return sorted(found, key=str)


def run(spark, rows, levels):
    df = spark.createDataFrame(rows, "k string, i long, d string, c string")
    made = merkle.manifest(df, "k", "i", "d", "c", levels=levels)
    return sorted((tuple(r) for r in made.collect()), key=str)


def sample(sizes, seed=3):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, rng.randrange(-50, 5000)]) if rng.random() < 0.1 else rng.randrange(-50, 5000), h(str(k), str(j))) for k, n in sizes.items() for j in range(n)]
    return [(k, i, d, h(d, "changed") if rng.random() < 0.3 else d) for k, i, d in rows]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_against_whole_trees(spark, levels):
    rows = sample({None: 9, "": 1, "en": 531, "de": 64, "fr": 65, "é": 8, "Z": 3, "z": 2, "es": 1, "it": 1})
    assert run(spark, rows, levels) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {None: 1, "a": 1}, {"en": 600}])
def test_few_groups(spark, sizes):
    rows = sample(sizes)
    assert run(spark, rows, 1) == brute(rows)


def test_equal_rows_and_one_id(spark):
    rows = [("en", 7, h("same"), h("same"))] * 40 + [("en", 7, h(str(i)), h("x")) for i in range(30)] + [("en", None, h("null"), h("x"))] * 3
    assert run(spark, rows, 1) == brute(rows)


def test_a_parent_resumes_its_states():
    children = [h(str(i)) for i in range(5)]
    parent = merkle.Parent("".join(children).encode())
    assert parent.digest.decode() == h(*children)
    for slot in range(5):
        other = [*children[:slot], h("new"), *children[slot + 1 :]]
        assert parent.fold(slot, h("new").encode()).decode() == h(*other)
        assert parent.siblings(slot).decode() == "".join(children[:slot] + children[slot + 1 :])


def test_query(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, rng.choice([None, "A Text É", "no capitals", "", "x" * 200_000 + "Y"]), rng.choice([None, "en", "de"]), rng.choice([None, "s1"]), rng.choice([None, 5])) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def lower(text):
        return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    rows = []
    for i, text, lang, source, n in docs:
        other = lower(text) if zlib.crc32(str(i).encode()) % 3 == 0 else text
        rows.append((lang, i, leaf([i, source, lang, n, text]), leaf([i, source, lang, n, other])))
    want = sorted((at, d, sub, root, proof, folded, folded == root) for _, at, d, sub, root, proof, folded in brute(rows))
    made = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(tuple(r) for r in made.collect()) == want
    assert {r[-1] for r in want} == {True, False}


def test_clashing_names(spark):
    df = spark.range(20).select(F.lit("g").alias("index"), F.col("id").alias("total"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key"), F.lit(1).alias("chunk"))
    rows = merkle.manifest(df, "index", "total", "key").collect()
    assert len(rows) == 20 and all(r.folded_root == r.root == r.subroot for r in rows)
