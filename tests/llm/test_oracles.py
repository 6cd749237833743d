import duckdb
import pytest

from namesake.llm.queries import ORACLE_SQL, QUERIES

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    want, have = c.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, TINY).toPandas()
    assert sorted(want.columns) == sorted(have.columns)
    shaped = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).values.tolist()))
    assert shaped(have) == shaped(want)
