import gzip
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pathsieve.operators.reports import scope_org
from pathsieve.sources import sitemaps, tables

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


@pytest.mark.parametrize(("raw", "root", "locs", "dropped", "error"), [
    (f"<?xml version='1.0'?><urlset {NS}><url><loc> https://e.com/a </loc></url><url><loc><![CDATA[https://e.com/b?x=1&y]]></loc></url><url><loc> </loc></url></urlset>", "urlset", ["https://e.com/a", "https://e.com/b?x=1&y"], False, None),
    ("<s:urlset xmlns:s='x'><s:url><s:loc>u</s:loc><s:image><s:loc>no</s:loc></s:image></s:url></s:urlset>", "urlset", ["u"], False, None),
    ("﻿<urlset></urlset>", "urlset", [], False, None), ("Warning: x in y.php\n<?xml version='1.0'?><urlset><url><loc>a</loc></url></urlset>", "urlset", ["a"], True, None),
    ("no markup at all", None, [], False, "NON_XML_PREAMBLE"), ("<html><body/></html>", "html", [], False, "WRONG_ROOT"), ("<URLSET><URL><LOC>a</LOC></URL></URLSET>", "urlset", ["a"], False, None),
    ("Error <html><body/></html>", None, [], False, "NON_XML_PREAMBLE"), ("x" * 600 + "<urlset></urlset>", None, [], False, "NON_XML_PREAMBLE"), ("a < b <urlset></urlset>", None, [], False, "NON_XML_PREAMBLE"), ("<urlset><url><loc>a</loc>", "urlset", [], False, "MALFORMED_XML"),
    ("<sitemapindex><sitemap><loc>c.xml</loc></sitemap></sitemapindex>", "sitemapindex", ["c.xml"], False, None),
])
def test_locations(raw, root, locs, dropped, error):
    for data in (raw.encode(), gzip.compress(raw.encode())):
        r, found, had, e = sitemaps.locations(data)
        assert (r, found, had) == (root, locs, dropped) and (e or "").startswith(error or "")


PAGE = "<url><loc>https://e.com/{}</loc></url>"


def test_gzip_in_pieces(monkeypatch):
    body = "<urlset>" + "".join(map(PAGE.format, range(3000))) + "</urlset>"
    want = [f"https://e.com/{i}" for i in range(3000)]
    half = len(body) // 2
    members = gzip.compress(body[:half].encode()) + gzip.compress(body[half:].encode()) + b"\0" * 9
    for size in (7, 4096, 1 << 16):
        monkeypatch.setattr(sitemaps, "PIECE", size)
        for raw in (body.encode(), gzip.compress(body.encode()), members):
            assert sitemaps.locations(raw) == ("urlset", want, False, None)
        assert sitemaps.locations(gzip.compress(body.encode())[:-20])[3].startswith("GZIP")
        assert sitemaps.locations(members[:-9] + b"junk")[3].startswith("GZIP")
    assert sitemaps.locations(b"\x1f\x8bno")[3].startswith("GZIP")
    monkeypatch.setattr(sitemaps, "INFLATED_BYTES", 1000)
    assert sitemaps.locations(members) == (None, [], False, "INFLATED_TOO_LARGE: more than 1000 bytes")
    monkeypatch.setattr(sitemaps, "LOC_CHARS", 100)
    assert sitemaps.locations(f"<urlset><url><loc>{'x' * 200}</loc></url></urlset>".encode())[3].startswith("LOC_TOO_LONG")


def test_files_of_more_locations_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(sitemaps, "HELD", 50)
    monkeypatch.setattr(sitemaps, "ROWS", 40)
    body = "<urlset>" + "".join(map(PAGE.format, range(5000)))
    files = spark.createDataFrame([("a", gzip.compress((body + "</urlset>").encode())), ("b", body.encode()), ("c", b"<urlset/>"), ("d", None)], "path string, content binary")
    rows = sitemaps.parse_sitemaps(files).collect()
    assert [(r.ordinal, r.loc) for r in rows if r.file_url == "a"] == [(i, f"https://e.com/{i}") for i in range(5000)]
    # what breaks off at its end has no locations at all
    assert {r.file_url: (r.ordinal, (r.error or "").split(":")[0]) for r in rows if r.file_url != "a"} == {"b": (None, "MALFORMED_XML"), "c": (None, ""), "d": (None, "NON_XML_PREAMBLE")}
    assert {r.error for r in sitemaps.parse_sitemaps(files.where("path = 'a'"), 1000).collect()} == {"INFLATED_TOO_LARGE: more than 1000 bytes"}


def test_memory_does_not_grow_with_the_inflated_file():
    code = """
import gzip, io, resource, sys
sys.path.insert(0, {root!r})
from pathsieve.sources import sitemaps
out = io.BytesIO()
with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1) as f:
    f.write(b"<urlset>")
    page = b"<url><loc>https://e.com/" + b"p" * 900 + b"</loc></url>"
    for _ in range(300):
        f.write(page * 1000)
    f.write(b"</urlset>")
raw = out.getvalue()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(part) for part in sitemaps.Locations(raw).parts())
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code.format(root=str(Path(__file__).resolve().parent.parent))], capture_output=True, text=True, timeout=300)
    n, grown = map(int, said.stdout.split())
    # 280 MB inflated
    assert n == 300_000 and grown < 40, said.stderr


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(gzip.compress(b"<urlset><url><loc>https://e.com/1</loc></url><url><loc>https://e.com/2</loc></url></urlset>"))
    (tmp_path / "b.xml").write_text("nothing")
    locs = sitemaps.read_sitemaps(spark, str(tmp_path)).cache()
    assert [(r.ordinal, r.loc) for r in locs.where("loc is not null").orderBy("ordinal").collect()] == [(0, "https://e.com/1"), (1, "https://e.com/2")]
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r.path[-5:]: (r.url_count, r.is_gzip, r.parse_status) for r in sitemaps.file_inventory(files, locs).collect()}
    assert got == {"a.xml": (2, True, "parsed"), "b.xml": (0, False, "failed")}


def test_indexes_and_sizes(spark):
    rows = [("i", "sitemapindex", 0, "j"), ("i", "sitemapindex", 1, "a"), ("j", "sitemapindex", 0, "i"), ("j", "sitemapindex", 1, "b"), ("a", "urlset", 0, "u"), ("b", "urlset", 0, "v")]
    locs = spark.createDataFrame(rows, "file_url string, root_element string, ordinal int, loc string")
    got = {r.file_url: (r.depth, r.status) for r in sitemaps.expand_sitemap_indexes(spark.createDataFrame([("i",)], "file_url string"), locs).collect()}
    assert got == {"i": (0, "skipped"), "j": (1, "skipped"), "a": (1, "pending"), "b": (2, "pending")}
    # j's children would make five files: none of them is reached
    rows = [("i", "sitemapindex", 0, "j"), ("i", "sitemapindex", 1, "a"), ("i", "sitemapindex", 2, "k"), ("j", "sitemapindex", 0, "b"), ("j", "sitemapindex", 1, "c"), ("k", "sitemapindex", 0, "d"), ("a", "urlset", 0, "u")]
    locs = spark.createDataFrame(rows, "file_url string, root_element string, ordinal int, loc string")
    got = {r.file_url: (r.status, r.reason, r.children) for r in sitemaps.expand_sitemap_indexes(spark.createDataFrame([("i",)], "file_url string"), locs, 5).collect()}
    assert got == {"i": ("skipped", "NESTED_SITEMAP_INDEX", 3), "j": ("skipped", "NESTED_SITEMAP_INDEX_OVER_LIMIT", 2), "a": ("pending", None, None), "k": ("pending", None, None)}
    got = sitemaps.expand_sitemap_indexes(spark.createDataFrame([("e",)], "file_url string"), spark.createDataFrame([("e", "sitemapindex", None, None)], locs.schema))
    assert [(r.status, r.reason) for r in got.collect()] == [("degraded", "SUSPICIOUSLY_EMPTY_INDEX")]
    files = spark.createDataFrame([(1, 100), (2, 300)], "id int, url_count long")
    assert sitemaps.assess_size(files).first().verdict == "ok"
    r = sitemaps.assess_size(files, soft_urls=200).first()
    assert (r.verdict, r.sample_multiplier) == ("degraded", 0.5)
    assert sitemaps.assess_size(files, hard_urls=10, hard_files=1).first().reason == "HARD_LIMIT_FILES"
    text = spark.createDataFrame([("a\n\n b \n",)], "value string")
    assert [(r.line, r.url) for r in sitemaps.read_url_lines(text).collect()] == [(0, "a"), (2, "b")]


def test_a_site_has_as_many_files_as_it_fills(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 100)
    df = spark.range(1000).select(F.when(F.col("id") < 950, "large").when(F.col("id") < 990, "small").alias("site_id"), F.col("id").alias("n"))
    tables.write_partitioned(df, f"{tmp_path}/t")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert files["site_id=small"] == files["site_id=__HIVE_DEFAULT_PARTITION__"] == 1 and 3 <= files["site_id=large"] <= 10
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1000


def test_a_scope_prunes_sites(spark, tmp_path):
    """The sites of an organization are found at run time, and only their folders are read."""
    df = spark.range(40_000).select(F.concat(F.lit("s"), F.col("id") % 8).alias("site_id"), F.col("id").alias("n"))
    tables.write_partitioned(df, f"{tmp_path}/t")
    spark.createDataFrame([(f"s{i}", f"o{i % 4}", None, True) for i in range(8)], "site_id string, org_id string, deleted_at timestamp, is_active boolean").write.parquet(f"{tmp_path}/sites")
    scoped = scope_org(spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/sites"), "o1")
    assert {r.site_id for r in scoped.select("site_id").distinct().collect()} == {"s1", "s5"}
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "site_id string, n int")
    tables.write_partitioned(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").where("site_id = 's1'").count() == 1
    o = spark.createDataFrame([(1, 'https://e.com/"x"', "/{param}", 200, "HEAD", False, False, None, 5)], "observation_id long, url string, pattern string, http_status int, method string, escalated_to_get boolean, is_soft_404 boolean, error_reason string, response_ms int")
    tables.export_observations_csv(o.withColumn("observed_at", F.lit("2024-01-02 03:04:05").cast("timestamp")), f"{tmp_path}/c")
    lines = [line.value for line in spark.read.text(f"{tmp_path}/c").collect()]
    assert lines[1] == '"https://e.com/""x""","/{param}","200","HEAD","false","false","","5","2024-01-02T03:04:05.000Z"'
