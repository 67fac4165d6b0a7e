"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from memlake.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}"
    return str(v) if not isinstance(v, bool) else str(int(v))


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = canon(df.columns, df.collect())
    assert got or name in ("gr_edge_reject",)
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        want = canon(rel.columns, rel.fetchall())
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == want
