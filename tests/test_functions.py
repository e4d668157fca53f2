import pytest
from pyspark.sql import functions as F

from pathsieve.functions import status as st
from pathsieve.functions import urls as ur


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [("", 2166136261), ("a", 3826002220), ("foobar", 3214735720)])
def test_stable_hash(spark, text, want):
    assert one(spark, text, ur.stable_hash(F.col("x"))) == want
    ur.register(spark)
    assert spark.sql(f"SELECT stable_hash('{text}') AS h").first().h == want


@pytest.mark.parametrize(("value", "want"), [("/nsn/niin-parts-12191", "/a/a-a-99999"), ("abc123def", "a999a"), ("/search?q=widget&page=3", "/a"), ("1" * 20, "9" * 12)])
def test_shapes(spark, value, want):
    assert one(spark, value, ur.path_shape(F.col("x"))) == want


@pytest.mark.parametrize(("loc", "kind", "path", "segments"), [
    (" https://www.Example.com/a/b?x=1#t ", "matched", "/a/b?x=1", ["a", "b"]), ("/a/./b/../c", "matched", "/a/c", ["a", "c"]), ("d/e", "matched", "/base/d/e", ["base", "d", "e"]),
    ("https://example.com", "matched", "/", []), ("https://other.com/x", "foreign", None, None), ("  ", "unparseable", None, None), (None, "unparseable", None, None), ("https://", "unparseable", None, None),
    ("/ü b", "matched", "/%C3%BC%20b", ["%C3%BC%20b"]), ("//example.com:8080/x", "matched", "/x", ["x"]), ("?p=2", "matched", "/base/?p=2", ["base"]),
])
def test_parse_loc(spark, loc, kind, path, segments):
    got = one(spark, loc, ur.parse_loc(F.col("x"), F.lit("https://example.com/base/"), F.lit("example.com")))
    assert (got.kind, got.path, got.segments) == (kind, path, segments)


def test_outcomes(spark):
    rows = [(404, False, 1, "not_found"), (410, False, 1, "gone"), (403, False, 1, "blocked"), (429, False, 1, "blocked"), (None, False, 1, "unknown"), (500, False, 1, "server_error"),
            (301, False, 1, "redirect_single"), (301, False, 3, "redirect_chain"), (200, True, 1, "soft_not_found"), (200, False, 1, "ok"), (418, False, 1, "unknown")]
    df = spark.createDataFrame(rows, "s int, soft boolean, hops int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", st.classify_outcome(F.col("s"), F.col("soft"), F.col("hops"))).collect())
    with pytest.raises(Exception, match="no weight"):
        one(spark, "odd", st.severity_weight(F.col("x"), st.SEVERITY_WEIGHTS))


@pytest.mark.parametrize(("body", "soft", "signal", "short"), [
    ("part AB404C" + "x" * 1000, False, None, False), ("error 404 here" + "x" * 1000, True, "404", False), ("tiny", True, None, True), ("x" * 70_000 + "page not found", False, None, False), ("Page Not Found" + "x" * 999, True, "page not found", False),
])
def test_soft404(spark, body, soft, signal, short):
    got = one(spark, body, st.detect_soft404(F.col("x")))
    assert (got.is_soft404, got.matched_signal, got.is_short_body) == (soft, signal, short)


def test_run_states(spark):
    assert one(spark, "STAGE_EXHAUSTED_RETRIES:VERIFY:x ECONNREFUSED", st.run_failure_reason(F.col("x"))).stage == "VERIFY"
    assert one(spark, None, st.project_run_state(F.col("x"), F.lit(1))) == "never_run"
    assert one(spark, 0, st.trend_percent(F.lit(5), F.col("x")), "int") is None
