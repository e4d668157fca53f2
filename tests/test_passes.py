from pyspark.sql import functions as F

from pathsieve.operators import passes

SCHEMA = "segments array<string>, path string, file_id int, ordinal long"


def rows_of(parts):
    """Passes as lists of (first segment, value, file)."""
    out, at = [], 0
    for part in parts:
        own = []
        for head, value, file in part:
            s = [head, *([] if value is None else [value])]
            own.append((s, "/" + "/".join(s), file, at))
            at += 1
        out.append(own)
    return out


def told(state):
    files = {(r.template, r.file_id): r.url_count for r in state.files.collect()}
    sample = {(r.template, r.hash, r.file_id, r.ordinal) for r in state.sample.collect()}
    return {tuple(r) for r in passes.summary(state).collect()}, files, sample, {tuple(r) for r in state.rules.collect()}


def test_three_saved_passes_are_one(spark, tmp_path):
    # what no pass has many of, all of them together have
    parts = rows_of([[("part", f"p{i}", i % 3) for i in range(k, 240, 3)] + [("about", None, 9)] * 2 + [("news", f"n{k}", k)] for k in range(3)])
    found = []
    for k, part in enumerate(parts):
        passes.observe(spark.createDataFrame(part, SCHEMA), capacity=25).save(f"{tmp_path}/{k}")
        found.append(passes.load(spark, f"{tmp_path}/{k}"))
    whole = passes.observe(spark.createDataFrame([r for p in parts for r in p], SCHEMA), capacity=25)
    merged = passes.merge(*found)
    assert told(merged) == told(whole)
    assert merged.apart.isEmpty() and passes.recount(merged, None) is merged
    # merging in steps gives the same
    assert told(passes.merge(passes.merge(found[2], found[0]), found[1])) == told(whole)
    assert {r.template for r in passes.summary(whole).collect()} == {"/part/{param}", "/about", "/news/n0", "/news/n1", "/news/n2"}


def test_what_comes_apart_is_named_and_counted_again(spark):
    first, second = rows_of([[("x", f"v{i % 20}", i % 2) for i in range(30)] + [("y", f"w{i}", 0) for i in range(150)], [("x", f"v{i % 20}", i % 5) for i in range(300)] + [("y", f"u{i}", 1) for i in range(9)]])
    a, b = (passes.observe(spark.createDataFrame(r, SCHEMA), capacity=10) for r in (first, second))
    assert [tuple(r) for r in a.rules.where("parent = 'x'").collect()] == [("x", None)]
    urls = spark.createDataFrame(first + second, SCHEMA)
    whole, merged = passes.observe(urls, capacity=10), passes.merge(a, b)
    assert {r.template for r in merged.apart.collect()} == {f"/x/v{i}" for i in range(20)}
    said = {r.template: r for r in passes.summary(merged).collect()}
    assert said["/y/{param}"].exact and said["/y/{param}"].file_count == 2
    assert not said["/x/v3"].exact and said["/x/v3"].population_count == 17 and said["/x/v3"].file_count is None
    assert told(passes.recount(merged, urls)) == told(whole)
    # a later merge still knows
    c = passes.observe(spark.createDataFrame(rows_of([[("x", "v1", 7)]])[0], SCHEMA), capacity=10)
    assert {r.template for r in passes.merge(merged, c).apart.collect()} == {f"/x/v{i}" for i in range(20)}


def test_empty_passes(spark):
    none = passes.observe(spark.createDataFrame([(None, "/", 0, 1)], SCHEMA))
    assert told(passes.merge(none, none)) == (set(), {}, set(), set())
    one = passes.observe(spark.createDataFrame([([], "/", 0, 1)], SCHEMA))
    assert told(passes.merge(none, one)) == told(one)
    assert one.sample.select(F.col("template")).collect()[0].template == "/"
