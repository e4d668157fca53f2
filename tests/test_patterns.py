"""Pattern learning against a tree in memory, decided by recursion."""

import random

import pytest
from pyspark.sql import functions as F

from pathsieve.operators import patterns
from pathsieve.operators.patterns import PARAM, SEP


class Tree:
    def __init__(self):
        self.ends, self.kids, self.param = 0, {}, None

    def every(self):
        return [*self.kids.values(), *([self.param] if self.param else [])]

    def urls(self):
        return self.ends + sum(x.urls() for x in self.every())

    def goes_on(self):
        return bool(self.kids or self.param)


def grown(rows):
    top = Tree()
    for segments, n in rows:
        at = top
        for s in segments:
            if s == PARAM:
                at.param = at.param or Tree()
                at = at.param
            else:
                at = at.kids.setdefault(s, Tree())
        at.ends += n
    return top


def united(trees):
    out = Tree()
    out.ends = sum(t.ends for t in trees)
    for name in {k for t in trees for k in t.kids}:
        out.kids[name] = united([t.kids[name] for t in trees if name in t.kids])
    params = [t.param for t in trees if t.param]
    out.param = united(params) if params else None
    return out


def folded(tree):
    """All below becomes the parameter's."""
    out = Tree()
    out.ends, out.param = tree.ends, united(tree.every())
    return out


def looks(tree, depth=2):
    if tree.param:
        return ("*", looks(tree.param, 1) if depth == 2 else tree.param.goes_on())
    if not tree.kids:
        return "$"
    return "*" if len(tree.kids) > patterns.NAMED else frozenset((k, t.goes_on()) for k, t in tree.kids.items())


def varies(n, through):
    return n > patterns.MANY or (through >= patterns.OBSERVED and n / through >= patterns.RATIO)


def take(tree, names):
    taken = [tree.kids.pop(k) for k in names]
    if any(t.param for t in taken):
        taken = [folded(t) for t in taken]
    tree.param = united([*([tree.param] if tree.param else []), *taken])


def decide(tree):
    for kid in tree.kids.values():
        decide(kid)
    if not tree.param:
        through = sum(t.urls() for t in tree.kids.values())
        if tree.kids and varies(len(tree.kids), through):
            groups = {}
            for name, kid in tree.kids.items():
                groups.setdefault(looks(kid), []).append(name)
            chosen = [x for g in groups.values() if len(groups) == 1 or varies(len(g), through) for x in g]
            if chosen:
                take(tree, chosen)
    if tree.param:
        same = [k for k, t in tree.kids.items() if looks(t) == looks(tree.param)]
        if same:
            take(tree, same)
        decide(tree.param)
    return tree


def slots(tree, prefix=()):
    if tree.param:
        yield SEP.join(prefix), None
        yield from ((SEP.join(prefix), k) for k in tree.kids)
        yield from slots(tree.param, (*prefix, PARAM))
    for k, t in tree.kids.items():
        yield from slots(t, (*prefix, k))


def walked(segments, rules):
    now = []
    for s in segments:
        here = SEP.join(now)
        now.append(PARAM if (here, None) in rules and (here, s) not in rules else s)
    return "/" + "/".join(now)


def sample(seed, n=260):
    rng = random.Random(seed)
    names = ["a", "b", "c"]
    heads = ["shop", "user", *(f"s{i}" for i in range(rng.randrange(8, 16)))]
    out = []
    for _ in range(n):
        path = [rng.choice(heads)]
        while len(path) < 5 and rng.random() < 0.7:
            few = path[0] in ("shop", "user") or len(path) > 1
            path.append(rng.choice([rng.choice(names), "a", f"v{rng.randrange(60)}", f"w{rng.randrange(300)}"]) if few else rng.choice(["page", "page", "list"]))
        out.append(path)
    return [*out, [], ["about"]]


@pytest.fixture
def low(monkeypatch):
    """Thresholds that small trees reach."""
    for name, value in (("MANY", 6), ("OBSERVED", 5), ("NAMED", 3)):
        monkeypatch.setattr(patterns, name, value)


def counted(spark, rows):
    return spark.createDataFrame([(SEP.join(s), n) for s, n in rows], "path string, n long")


@pytest.mark.parametrize("seed", [4, 9])
def test_against_a_tree(spark, low, seed):
    urls = sample(seed)
    rules = {(r.parent, r.literal) for r in patterns.learn_from_counts(patterns.path_counts(spark.createDataFrame([(u,) for u in urls], "segments array<string>"))).collect()}
    assert rules == set(slots(decide(grown([(u, 1) for u in urls]))))
    assert rules


def test_counts_that_hold_parameters(spark, low):
    rows = [(["x", PARAM, "p"], 3), (["x", "y", "p"], 1), (["x", "z", "q"], 1), (["x", PARAM], 2), (["w", PARAM], 1), (["w", "v"], 1), (["w", "u", "t"], 2), *((["x", PARAM, "k", f"{i}"], 1) for i in range(9))]
    rules = {(r.parent, r.literal) for r in patterns.learn_from_counts(counted(spark, rows)).collect()}
    assert rules == set(slots(decide(grown(rows))))
    assert ("w", "u") in rules and ("w", "v") not in rules


def test_names_that_look_like_the_merged_parameter_join_it(spark, low):
    # two groups become the parameter; what holds both groups' names looks like neither, but like what they became
    rows = [([f"a{i}", "open"], 9) for i in range(8)] + [([f"d{i}", "done"], 9) for i in range(8)] + [([f"b{i}", x], 9) for i in range(2) for x in ("open", "done")] + [(["help", "me"], 9)]
    rules = {(r.parent, r.literal) for r in patterns.learn_from_counts(counted(spark, rows)).collect()}
    assert rules == {("", None), ("", "help")} == set(slots(decide(grown(rows))))


@pytest.mark.parametrize("inline", [1000, 0])
def test_assignment_walks_the_rules(spark, low, monkeypatch, inline):
    monkeypatch.setattr(patterns, "INLINE", inline)
    urls = sample(11)
    df = spark.createDataFrame([(u, 1) for u in [*urls, ["new", "v1"], ["shop", "unseen", "x"], None]], "segments array<string>, path int")
    rules = patterns.learn_patterns(df.where("segments is not null"))
    known = {(r.parent, r.literal) for r in rules.collect()}
    rows = patterns.assign_patterns(df, rules).collect()
    assert len(rows) == len(urls) + 3 and rows[0].__fields__ == ["segments", "path", "template"]
    for r in rows:
        assert r.template == (None if r.segments is None else walked(r.segments, known))
    plan = patterns.assign_patterns(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (inline == 0)


def test_passes_add_up(spark, low):
    urls = sample(21, 400)
    df = spark.createDataFrame([(i % 3, u) for i, u in enumerate(urls)], "pass int, segments array<string>")
    parts = [patterns.path_counts(df.where(f"pass = {i}")) for i in range(3)]
    whole = {tuple(r) for r in patterns.learn_patterns(df).collect()}
    assert {tuple(r) for r in patterns.learn_from_counts(patterns.merge_pattern_passes(*parts)).collect()} == whole
    assert whole != {tuple(r) for r in patterns.learn_from_counts(parts[0]).collect()}


def test_larger_tables_are_shuffled(spark, low, monkeypatch):
    monkeypatch.setattr(patterns, "BROADCAST", 0)
    urls = sample(4)
    rules = {(r.parent, r.literal) for r in patterns.learn_patterns(spark.createDataFrame([(u,) for u in urls], "segments array<string>")).collect()}
    assert rules == set(slots(decide(grown([(u, 1) for u in urls]))))


def test_few_urls_keep_their_names(spark):
    u = spark.createDataFrame([(1, ["a", str(i)]) for i in range(29)] + [(1, [])], "file_id int, segments array<string>")
    assert patterns.learn_patterns(u).count() == 0
    got = {r.template for r in patterns.assign_patterns(u, patterns.learn_patterns(u)).collect()}
    assert got == {f"/a/{i}" for i in range(29)} | {"/"}
    assert patterns.learn_patterns(u.limit(0)).count() == 0
    assert patterns.learn_patterns(u.where("size(segments) = 0")).count() == 0


def test_the_ratio_counts_urls_that_go_on(spark):
    # 30 URLs end at the prefix: of the 30 that go on, 20 are different
    u = spark.createDataFrame([(["a"],)] * 30 + [(["a", str(i % 20)],) for i in range(30)], "segments array<string>")
    assert [tuple(r) for r in patterns.learn_patterns(u).collect()] == [("a", None)]


def test_every_round_decides_all_depths(spark, monkeypatch):
    calls = []
    rewrite = patterns._rewrite
    monkeypatch.setattr(patterns, "_rewrite", lambda *a: calls.append(a[3]) or rewrite(*a))
    rows = [["x", str(i)] for i in range(200)] + [["y", "z", str(i)] for i in range(200)] + [["k", "l", "m", str(i)] for i in range(200)]
    rules = patterns.learn_patterns(spark.createDataFrame([(r,) for r in rows], "segments array<string>"))
    assert {r.parent for r in rules.collect()} == {"x", f"y{SEP}z", f"k{SEP}l{SEP}m"}
    assert calls == [{1: 1, 2: 1, 3: 1}]
    assert rules.where(F.col("literal").isNotNull()).count() == 0


def test_no_key_of_a_join_is_that_of_most_nodes(spark, monkeypatch):
    """Nodes without anything inside to look up don't meet in one task; tasks are small while learning only."""
    from pathsieve.operators.upserts import ADVISORY, TASK_BYTES

    rows = [(["order", str(i), "line", str(i % 3)],) for i in range(300)] + [(["shop", str(i)],) for i in range(500)]
    u, largest, sizes, before = spark.createDataFrame(rows, "segments array<string>"), [], set(), spark.conf.get(ADVISORY)
    join = type(u).join

    def watched(self, other, on=None, how=None):
        sizes.add(spark.conf.get(ADVISORY))
        if on == "_inner":
            largest.append(self.groupBy("_inner").count().agg(F.max("count")).first()[0])
        return join(self, other, on, how)

    with monkeypatch.context() as m:
        m.setattr(type(u), "join", watched)
        rules = patterns.learn_patterns(u)
    assert largest and max(largest) == 1
    assert sizes == {TASK_BYTES} and spark.conf.get(ADVISORY) == before
    got = {r.template: r.n for r in patterns.assign_patterns(u, rules).groupBy("template").agg(F.count("*").alias("n")).collect()}
    assert got == {"/shop/{param}": 500} | {f"/order/{{param}}/line/{i}": 100 for i in range(3)}
