"""The registry loads without a session, and its queries agree with their SQL on the smallest tables."""

import glob
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 140 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
@pytest.mark.parametrize("name", ["album_overview", "album_status", "pages_reordered", "integrity_report", "idle_islands", "connected_components", "shot_pair_shares", "replay_summary"])
def test_query_matches_sql(spark, name):
    import duckdb

    from pagequarry.mappings import Tables
    from pagequarry.registry import load

    q = load()[name]
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = q.run(Tables(spark, SF))
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(str([row[names.index(c)] for c in cols]) for row in cur.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want


def test_integrity_hashes_files_after_they_are_told_apart(spark, tmp_path):
    from pagequarry.mappings import Tables
    from pagequarry.registry import jobs, load

    li = [(1, 1, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 0.08, 0.0), (2, 1, 0.0, 0.1), (3, 1, 0.0, 0.0), (4, None, None, 0.0), (5, 1, 0.08, 0.1)]
    spark.createDataFrame([(k, n, tax, d, 1, 1, 1.0, 1.0) for k, n, tax, d in li], "l_orderkey long, l_linenumber int, l_tax double, l_discount double, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").selectExpr("*", "DATE'2024-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 11), (5, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    files = jobs._files(t)
    assert sorted((r.path or "").rsplit("/albums/")[-1] for r in files.collect()) == ["", "", "10/photos/1/1-1.jpg", "10/photos/2/1-2.jpg", "10/photos/2/2-1.jpg", "11/photos/4/4.jpg"]
    got = sorted((r.kind, r.page_id, r.shot_id) for r in load()["integrity_report"].run(t).filter("album_id IS NOT NULL").collect())
    assert got == [("changed", 2, "2-1"), ("extra", 2, "1-2"), ("missing", 1, "1-2")]
    below = files._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1].split("\n", 1)[1]
    assert "sha2" not in below
