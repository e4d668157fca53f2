"""Locations are parsed step by step, each once, and only where they are wanted."""

import pytest
from pyspark.sql import functions as F

from pathsieve.functions import urls
from pathsieve.operators import patterns

BASE, HOST = "https://example.com/dir/page?q#f", "www.Example.com"


@pytest.mark.parametrize("loc,kind,path,host", [
    ("https://user:pw@example.com/x", "matched", "/x", None), ("https://[::1]:8080/p", "foreign", None, "[::1]"), ("https://exa mple.com/x", "unparseable", None, None),
    ("https:///nohost", "unparseable", None, None), ("https://example.com?", "matched", "/", None), ("https://example.com?x", "matched", "/?x", None), ("HTTP://WWW.EXAMPLE.COM:80/A", "matched", "/A", None),
    ("//cdn.example.com/x", "foreign", None, "cdn.example.com"), ("?q=1", "matched", "/dir/page?q=1", None), ("#top", "matched", "/dir/page", None), ("rel", "matched", "/dir/rel", None), ("../up/./x", "matched", "/up/x", None),
    ("https://example.com/a/../b/..", "matched", "/", None), ("https://example.com/é?ü=ä b", "matched", "/%C3%A9?%C3%BC=%C3%A4%20b", None), ("mailto:a@b", "unparseable", None, None),
    ("https://example.com/a\x01b", "matched", "/a\x01b", None), ("  ", "unparseable", None, None), (None, "unparseable", None, None),
])
def test_locations(spark, loc, kind, path, host):
    (row,) = spark.createDataFrame([(loc,)], "loc string").select(urls.parse_loc(F.col("loc"), F.lit(BASE), F.lit(HOST)).alias("p")).select("p.*").collect()
    assert (row.kind, row.path, row.detected_host) == (kind, path, host)
    assert row.segments == (None if path is None else [s for s in path.split("?")[0].split("/") if s])


def test_each_step_is_in_the_plan_once(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("loc"))
    split = patterns.split_locs(df, BASE, HOST).select("path", "segments", "detected_host", "kind")
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(urls._PARTS[4:40]) == 2 and len(plan) < 10_000


def test_only_sampled_locations_are_parsed(spark):
    locs = spark.createDataFrame([(1, i, f"https://example.com/p/{i}") for i in range(5)] + [(2, 0, "https://other.org/x"), (3, 0, "https://example.com/y")], "file_id int, ordinal int, loc string")
    hashed = [(1, 0, "/p/0"), (1, 3, "/p/3"), (2, 0, "/x"), (3, 0, "/changed"), (3, 7, "/y"), (9, 0, "/z")]
    samples = spark.createDataFrame(hashed, "file_id int, ordinal int, p string").select("file_id", "ordinal", urls.stable_hash(F.col("p")).alias("hash"))
    made = patterns.resolve_candidates(samples, locs, "https://example.com/", "example.com")
    got = {(r.file_id, r.ordinal): (r.status, r.path, r.file_ok) for r in made.collect()}
    assert got == {
        (1, 0): ("resolved", "/p/0", True), (1, 3): ("resolved", "/p/3", True), (2, 0): ("off_host", None, False),
        (3, 0): ("hash_mismatch", "/y", False), (3, 7): ("missing_ordinal", None, False), (9, 0): ("unknown_file", None, False),
    }
    tree = patterns._located(samples, locs, "https://example.com/", "example.com")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    parsing = [i for i, line in enumerate(tree) if "://" in line]
    semi = [i for i, line in enumerate(tree) if "LeftSemi" in line]
    # the one projection that parses stands above a semi join with the sample
    assert len(parsing) == 1 and any(i > parsing[0] for i in semi)
