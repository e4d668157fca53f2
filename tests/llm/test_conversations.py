import hashlib
import itertools
import random
import re
import zlib

import pytest

from pathsieve.llm import conversations as c

BLANK = " \t\n\v\f\r"


def cheapest(codes, start="", complete=r"(s?(ua)+)?"):
    """Every way to edit turns (initial, fault), by full search with bounded inserts; least (cost, audit)."""
    best = None
    slots = len(codes) + 1
    for choice in itertools.product("KRrD", repeat=len(codes)):
        if any((f in (1, 2) and e != "D") for e, (_, f) in zip(choice, codes)):
            continue
        cost = sum({"K": 0, "R": 1, "r": 1, "D": 2}[e] + (5 if f == 3 and e != "D" else 0) for e, (_, f) in zip(choice, codes))
        for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=slots):
            total = cost + 5 * sum(map(len, inserts))
            if best and total > best[0]:
                continue
            roles = audit = ""
            for i in range(slots):
                roles += inserts[i]
                audit += "I" * len(inserts[i])
                if i < len(codes):
                    e = choice[i]
                    roles += {"K": codes[i][0] if codes[i][0] else "-", "R": "u", "r": "a", "D": ""}[e]
                    audit += e.upper()
            if re.fullmatch(complete, roles) and (best is None or (total, audit) < best):
                best = (total, audit)
    return best


def test_search_against_all_ways():
    rng = random.Random(2)
    for _ in range(250):
        codes = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3, 3])) for _ in range(rng.randrange(0, 5))]
        assert c.cheapest(codes) == cheapest(codes), codes


def plain(codes):
    """Least (cost, audit) from the last turn backwards, for longer conversations."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    n, memo = len(codes), {}
    for i in range(n, -1, -1):
        ways = {}
        for last in after:
            found = [(0, "")] if i == n and last in ("", "a") else []
            if i < n:
                initial, fault = codes[i]
                found.append((2 + memo[i + 1][last][0], "D" + memo[i + 1][last][1]))
                if fault in (0, 3):
                    more = 5 * (fault == 3)
                    cost, rest = memo[i + 1][after[last]]
                    found.append((1 + more + cost, "R" + rest))
                    if initial == after[last] or (initial == "s" and last == ""):
                        cost, rest = memo[i + 1][initial]
                        found.append((more + cost, "K" + rest))
            ways[last] = min(found, default=(10**9, ""))
        for _ in range(3):
            for last, to in after.items():
                ways[last] = min(ways[last], (5 + ways[to][0], "I" + ways[to][1]))
        memo[i] = ways
    return memo[0][""]


def brute(rows):
    """rows of (conv, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes = set(), []
        for _, role, text in own:
            rest = text.strip(BLANK)
            codes.append((role[:1], 1 if not rest else 2 if (role, text) in seen else 0 if rest[-1] in ".!?" else 3))
            seen.add((role, text))
        cost, audit = plain(codes)
        left, done = iter(own), []
        for e in audit:
            _, role, text = ("", "", "") if e == "I" else next(left)
            if e != "D":
                if e != "K":
                    last = done[-1].split(":")[0][:1] if done else ""
                    role = "assistant" if last == "u" else "user"
                done.append(f"{role}:{text}")
        turns = {r[0] for r in own if r[0] is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == k for _, f in codes) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def sample(sizes, seed=4):
    rng = random.Random(seed)
    rows = []
    for conv, n in sizes.items():
        for i in range(n):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            text = rng.choice([f"Said {i}.", f"Said {i}!", f"Cut {i}", "Again.", " \n", "", None, "Ends. \t", "É?"])
            rows.append((conv, rng.choice([None, i, i, i, i + 3, i // 2]), role, text))
    rng.shuffle(rows)
    return rows


def run(spark, rows, kind="long"):
    return sorted((tuple(r) for r in c.repair(spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string")).collect()), key=str)


def test_plain_search_agrees():
    rng = random.Random(8)
    for n in [0, 1, 2, 3, 5, 9, 40, 200]:
        for _ in range(6):
            codes = [(rng.choice("suat") if rng.random() < 0.5 else "ua"[i % 2], rng.choice([0, 0, 0, 0, 1, 2, 3])) for i in range(n)]
            assert c.cheapest(codes) == plain(codes)


def test_conversations(spark):
    rows = sample({i: i % 13 + 1 for i in range(60)} | {None: 4, 77: 150})
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_long_conversations_are_cut(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 5)
    monkeypatch.setattr(c, "JOINED", 3)
    monkeypatch.setattr(c, "PIECE_BYTES", 30)
    rows = sample({1: 3, 2: 5, 3: 6, 4: 10, 5: 61, 6: 170, None: 23}) + [(8, 1, "user", "Same.")] * 12 + [(9, i, "system", "") for i in range(11)]
    assert run(spark, rows) == brute(rows)
    turns = c.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), turns=True).collect()
    texts = {}
    for r in sorted(turns, key=lambda r: r.position):
        texts.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for conv, *_, digest in brute(rows):
        assert hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == digest
    # the bytes of a text decide as well
    monkeypatch.setattr(c, "BLOCK", 50)
    monkeypatch.setattr(c, "BLOCK_BYTES", 100)
    assert run(spark, rows) == brute(rows)


def test_names_of_conversations(spark):
    rows = [(f"k{k}" if k else None, t, r, x) for k, t, r, x in sample({i: 4 for i in range(5)})]
    assert run(spark, rows, "string") == brute(rows)
    df = spark.createDataFrame([(1, "user", 0, "Hi.", 9), (1, "assistant", 1, "Ho.", 9)], "digest long, conv string, index long, audit string, cost long")
    (row,) = c.repair(df, "digest", "index", "conv", "audit").collect()
    assert (row.conv, row.cost, row.audit) == (1, 0, "KK")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_query(spark, tmp_path, seed):
    rows = sample({i: 1 + i % 4 for i in range(120)} | {None: 3}, seed)
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r[0]: r for r in brute(damaged(rows))}
    empty = hashlib.sha256(b"").hexdigest()
    want = sorted((found.get(k, (k, 0, 0, 0, 0, 0, 0, "", empty)) for k in {r[0] for r in rows}), key=str)
    made = c.op11_conversation_repair(spark, str(tmp_path))
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in made.collect()), key=str) == want
    assert any(k not in found for k in {r[0] for r in rows})
