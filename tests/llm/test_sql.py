import duckdb
import pytest

from memlake.llm import registry
from tests.test_oracles import canon

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    got = canon(df.columns, df.collect())
    assert got and sorted(df.columns) == sorted(want.columns) and got == canon(want.columns, want.fetchall())
