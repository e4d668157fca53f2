import collections
import random

from pathsieve.llm import line_dedup


def brute(rows, shortest=20, documents=3):
    """rows of (id, text); what stays of each, with its counts."""

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    holders = collections.defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= shortest:
                    holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < shortest or len(holders[key(x)]) < documents or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup(df, **options).collect()), key=str)


LONG = "a line of more than twenty letters"


def test_random_texts(spark):
    rng = random.Random(5)
    stock = [f"{'Shared line number ' * (1 + i % 3)}{i}" for i in range(12)] + ["short", "", "  ", "\t"]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + (x := rng.choice(stock)).upper() if rng.random() < 0.3 else rng.choice(stock) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shortest=3, documents=5) == brute(rows, 3, 5)


def test_cases(spark):
    rows = [
        (1, None), (2, ""), (3, LONG), (4, f"{LONG}\n{LONG}\nown"), (5, f"x\n \t{LONG.upper()} \v\f\r\ny\n"), (6, f"\n{LONG}\n\n{LONG}"),
        (7, "É" * 20), (8, "É" * 20), (9, "é" * 20), (10, "É" * 19 + "\n" + "É" * 20), (11, "x" * 19), (12, "x" * 19), (13, "x" * 19),
        # two documents aren't enough, however often they hold it
        (14, "held by two documents only\n" * 3), (15, "held by two documents only"),
        (None, LONG), (None, LONG),
        # rows that share an id are one document
        (16, "three rows of two documents"), (16, "three rows of two documents"), (17, "three rows of two documents"), (17, LONG), (17, LONG),
        (18, "\n".join([LONG, "keep"] * 3000)), (19, LONG),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_hot_keys_are_broadcast(spark, monkeypatch):
    rows = [(i, f"{LONG}\n{LONG} again {i % 4}\nown {i}") for i in range(50)]
    monkeypatch.setattr(line_dedup, "KEY_LINES", 20)
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 1)
    assert run(spark, rows) == brute(rows)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, LONG, "x", i) for i in range(4)], "kept long, n_lines string, pos string, id long")
    rows = line_dedup.dedup(df, "kept", "n_lines").collect()
    assert rows[0].__fields__ == ["pos", "id", "n_lines", "n_dropped", "kept"]
    assert sorted((r.id, r.n_dropped, r.kept) for r in rows) == [(0, 1, ""), (1, 1, ""), (2, 1, ""), (3, 0, LONG)]
