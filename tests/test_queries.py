import duckdb
import pytest

import __spark_entry__ as entry
from pathsieve.operators.upserts import ADVISORY
from pathsieve.plans import queries as plans
from pathsieve.plans.derived import BASE

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["b2_parse_loc", "b3_stable_hash", "e7_pattern_summary", "f1_k_smallest", "h9_findings", "i14_roll_up", "k6_portfolio", "m2_stream_tallies", "q1_finding_rules"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{FOLDER}/{b}.parquet'")
    rows = plans.queries()[name](spark, FOLDER)
    found = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(rows.columns)

    def plain(v):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None else str(v)

    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=str) == want


@pytest.mark.parametrize(("regions", "nations", "suppliers"), [(5, 25, 60_000), (5, 25, 49_969), (5, 25, 49_970), (3, 50_001, 4)])
def test_expanded_indexes_beyond_the_limit_of_files(spark, tmp_path, regions, nations, suppliers):
    """The walk ends at 50 000 files, and the SQL says so."""
    own = {
        "region": f"SELECT cast(i AS INT) AS r_regionkey, 'r' AS r_name FROM range({regions}) t(i)",
        "nation": f"SELECT cast(i AS INT) AS n_nationkey, 'n' AS n_name, cast(i % {regions} AS INT) AS n_regionkey FROM range({nations}) t(i)",
        "supplier": f"SELECT i AS s_suppkey, cast(i % 25 AS INT) AS s_nationkey FROM range({suppliers}) t(i)",
    }
    con = duckdb.connect()
    for b, sql in own.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{b}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{tmp_path}/{b}.parquet'")
    columns = ("file_url", "depth", "status", "reason", "children")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({plans.oracle_sql()['a4_expand_indexes']})").fetchall()
    got = [tuple(r) for r in plans.queries()["a4_expand_indexes"](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ("NESTED_SITEMAP_INDEX_OVER_LIMIT" in {r[3] for r in got}) == (suppliers != 49_969)


def test_what_is_replaced_is_counted_once_and_stored(spark):
    """Counting and sorting are not in one task: the rows to sort are read from small stored parts."""
    before = spark.conf.get(ADVISORY)
    rows = plans.queries()["l3_upsert_replace"](spark, FOLDER)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 2 and "parquet" not in plan and spark.conf.get(ADVISORY) == before
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{FOLDER}/lineitem.parquet'")
    want = con.execute(f"SELECT pattern_id, file_id, url_count FROM ({plans.oracle_sql()['l3_upsert_replace']})").fetchall()
    assert sorted((r.pattern_id, r.file_id, r.url_count) for r in rows.collect()) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
