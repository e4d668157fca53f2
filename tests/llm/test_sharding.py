import collections

from pathsieve.llm import sharding
from pathsieve.llm.sharding import shard


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_against_the_published_loop(spark):
    keys = [*range(-50, 400), 2**63 - 1, -(2**63), 7, 7, 7, None]
    df = spark.createDataFrame([(k, "x" * 1) for k in keys], "k long, extra string")
    rows = shard(df, "k", 24, "extra").collect()
    assert len(rows) == len(keys)
    slots = collections.defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(r.k or 0, 24), jump(r.k or 0, 25))
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shard(df.limit(0), "k", 24).count() == 0


def test_clashing_names_and_equal_rows(spark):
    df = spark.createDataFrame([(k % 5, "a", "b") for k in range(3000)], "shard long, slot string, `_n` string")
    rows = shard(df, "shard", 3, "slot", "_n").collect()
    assert rows[0].__fields__ == ["_n", "shard", "slot", "grown_shard"] and len(rows) == 3000
    own = collections.defaultdict(list)
    for r in rows:
        own[r.shard].append(r.slot)
    assert {s: len(x) for s, x in own.items()} == collections.Counter(jump(k % 5, 3) for k in range(3000))
    assert all(sorted(x) == list(range(len(x))) for x in own.values())
    assert shard(df.withColumnRenamed("slot", "hit").withColumnRenamed("_n", "grown_shard"), "shard", 3, "hit", "grown_shard").columns == ["hit", "shard", "slot", "grown_shard"]


def test_many_equal_rows_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 100)
    keys = [7] * 2350 + [8] * 100 + [9] * 101 + list(range(50)) + [None] * 300
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, extra string")
    own, held = collections.defaultdict(list), collections.Counter()
    for r in shard(df, "k", 5, "extra").collect():
        assert r.shard == jump(r.k or 0, 5)
        own[r.shard].append(r.slot)
        held[r.k] += 1
    assert held == collections.Counter(keys)
    assert all(sorted(x) == list(range(len(x))) for x in own.values())
