"""Every query of the catalogue against its SQL twin in DuckDB."""

import duckdb
import pytest

from orrery.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"bigint": "int64", "int": "int32", "double": "double", "string": "string", "boolean": "bool"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLE_SQL[name]).to_arrow_table()
    assert {c: KINDS[k] for c, k in got.dtypes} == {f.name: str(f.type) for f in want.schema}
    rows = lambda t: sorted(str(sorted(r.items())) for r in t.to_pylist())
    assert rows(got.toArrow()) == rows(want)


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
