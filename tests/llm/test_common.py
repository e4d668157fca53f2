import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathsieve.llm import common
from pathsieve.llm.common import ENTRY_BITS, connected_components, durable, filter_of, forget, may_hold


@pytest.mark.parametrize("hot", [3, 20_000])
def test_components_against_union_find(spark, monkeypatch, hot):
    """Stars, chains and cliques; with few links a task, the links of every larger star are dealt out."""
    monkeypatch.setattr(common, "HOT_NODE", hot)
    pick = random.Random(hot)
    edges = [(500, 500 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(a, b) for a in range(5) for b in range(5)]
    edges += [(pick.randint(200, 320), pick.randint(200, 320)) for _ in range(90)] + edges[:10] + [(None, 3), (4, None), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    made = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in made} == {x: find(x) for x in root} and len(made) == len(root)


def test_forgotten_frames_leave_no_files(spark):
    import glob

    kept = durable(spark.range(10))
    gone = durable(spark.range(20))
    file = gone._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert glob.glob(f"{file}/part-*")
    forget(gone, spark.range(3))
    assert not glob.glob(f"{file}/*")
    assert kept.count() == 10


@pytest.mark.parametrize("n", [0, 1, 5_000])
def test_filter_holds_every_hash(spark, n):
    hashes = spark.range(n).select(F.xxhash64("id").alias("h")).union(spark.createDataFrame([(None,)], "h long"))
    words = filter_of(hashes.repartition(3), "h")
    assert words.dtype == np.uint64 and 64 * len(words) >= ENTRY_BITS * n
    own = np.array([r.h for r in hashes.where("h is not null").collect()], np.int64)
    assert may_hold(words, own).all()
    others = np.array([r.h for r in spark.range(10_000, 15_000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    assert may_hold(words, others).mean() < 0.1


def test_full_filter_is_small_in_the_driver(spark):
    """400 000 hashes fill most of 131 072 words, 2 MB as Arrow columns; as rows of Python they took tens."""
    hashes = spark.range(400_000).select(F.xxhash64("id").alias("h"))
    filter_of(hashes.limit(10), "h")
    tracemalloc.start()
    words = filter_of(hashes, "h")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (words != 0).mean() > 0.9 and peak < 10 * words.nbytes
