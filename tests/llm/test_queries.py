"""Registered queries against their oracle SQL, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from pagemill.llm import queries
from tools import compare

SF = os.environ.get("PAGEMILL_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = compare.rows_of(df.columns, df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    rows, names = cur.fetchall(), [c[0] for c in cur.description]
    assert got == compare.rows_of(names, rows)


def test_names():
    names = set(entry.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op3_line_windows", "op5_external_shuffle", "op7_quality_rules", "op8_benchmark_containment", "op10_url_lists"])
def test_native_plans(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoopJoin"):
        assert word not in plan
