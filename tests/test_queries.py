"""Every registered query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from tidemark.plans import lifecycle, records  # noqa: F401  add their queries
from tidemark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str):
        return value
    if isinstance(value, int | float) or type(value).__name__ in ("Decimal",):
        return f"{float(value):.9g}"
    return str(value)[:19].removesuffix(" 00:00:00")


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    rows = sorted([tuple(plain(r[c]) for c in order) for r in got.collect()], key=str)
    held = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()], key=str)
    assert rows == held


def test_plan_flow_gathers_no_history(spark):
    plan = QUERIES["plan_flow"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lead(" in plan
