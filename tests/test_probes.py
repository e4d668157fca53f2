import random

import pytest
from pyspark.sql import functions as F

from pathsieve.operators import probes, segments

SCHEMA = "host string, seq long, at double, status int"


def walked(rows):
    """Openings of every host, its probes one by one."""
    out = set()
    for host in {r[0] for r in rows}:
        last, streak, until = None, 0, float("-inf")
        for _, seq, at, status in sorted((r for r in rows if r[0] == host), key=lambda r: (r[2], r[1])):
            if at < until:
                continue
            streak = (streak + 1 if status == last else 1) if status in (429, 403) else 0
            last = status if streak else None
            if streak and streak >= {429: 5, 403: 10}[status]:
                out.add((host, seq, {429: "TOO_MANY_REQUESTS", 403: "FORBIDDEN"}[status]))
                last, streak, until = None, 0, at + 300
    return out


def runs(rows):
    out = {}
    for host in {r[0] for r in rows}:
        last, n = None, 0
        for _, seq, _, status in sorted((r for r in rows if r[0] == host), key=lambda r: r[1]):
            n = (n + 1 if status == last else 1) if status in (429, 403) else 0
            last = status
            out[host, seq] = n
    return out


def log(seed, n=1500, ordered=True):
    rng = random.Random(seed)
    rows, seq, at = [], 0, {}
    for _ in range(n):
        host = rng.choice([None, "hot", "hot", "hot", "b"])
        seq += rng.randrange(1, 3)
        at[host] = at.get(host, 0.0) + rng.choice([0, 1, 5, 30, 80, 400]) * (1 if ordered or rng.random() < 0.7 else -0.5)
        kind = (seq // rng.choice([20, 60])) % 4
        rows.append((host, seq, at[host], rng.choice([429] * 8 + [None]) if kind == 0 else rng.choice([403] * 14 + [200]) if kind == 1 else rng.choice([429, 403, 200, None]) if kind == 2 else 429))
    return rows


@pytest.mark.parametrize("piece,seed,ordered", [(3, 1, True), (7, 2, False), (40, 3, True), (8192, 4, True)])
def test_pieces_against_one_walk(spark, monkeypatch, piece, seed, ordered):
    monkeypatch.setattr(segments, "PIECE", piece)
    rows = log(seed, ordered=ordered)
    df = spark.createDataFrame(rows, SCHEMA)
    want = walked(rows)
    assert {tuple(r) for r in probes.refusal_circuits(df).collect()} == want and len(want) > 5
    assert {(r.host, r.seq): r.in_a_row for r in probes.refusal_runs(df).collect()} == runs(rows)


def test_a_long_run_goes_through_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(segments, "PIECE", 4)
    rows = [("h", i, i * 1.0, 429) for i in range(900)] + [("i", i, i * 50.0, 403) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in probes.refusal_circuits(df).collect()} == walked(rows)
    placed = segments.in_pieces(df, ["host"], ["seq"])
    assert placed.where("host = 'h'").select("piece").distinct().count() >= 225
    assert max(r.in_a_row for r in probes.refusal_runs(df).collect()) == 900
    assert probes.refusal_circuits(df.limit(0)).count() == 0


def test_sums_are_carried(spark, monkeypatch):
    monkeypatch.setattr(segments, "PIECE", 5)
    df = spark.range(200).select((F.col("id") % 3 == 0).alias("k"), F.col("id").alias("seq"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    got = {r.seq: r.total for r in segments.running_sum(segments.in_pieces(df, ["k"], ["seq"]), ["k"], ["seq"], F.col("v"), "total").collect()}
    sums = {True: 0, False: 0}
    for i in range(200):
        sums[i % 3 == 0] += i if i % 7 else 0
        assert got[i] == sums[i % 3 == 0]
