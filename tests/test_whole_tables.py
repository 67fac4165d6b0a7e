"""Registered queries that must answer for every row of their tables."""

import pytest
from pyspark.sql import functions as F

from memlake.operators import hdc
from memlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["hv_cleanup", "hv_resonate"])
def test_every_part_is_cleaned_up(spark, name):
    kinds = {r.p_partkey: r.p_type for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    got = registry.QUERIES[name](spark, SF).collect()
    assert len(got) == len(kinds) and {r.id: r.symbol for r in got} == kinds  # 16 of 256 bits flipped leave the type nearest
    assert {r.sim for r in got} == {0.9375}


def _bundled(maps, dim):
    vectors = [0 if v is None else hdc._symbol(k, dim) ^ hdc._symbol(v, dim) for m in maps for k, v in m.items()]
    won = sum(1 << i for i in range(dim) if 2 * sum(v >> i & 1 for v in vectors) > len(vectors))
    return [won >> 32 * w & 0xFFFFFFFF for w in range(-(-dim // 32))]


def test_maps_are_bundled_without_broadcast(spark, tmp_path):
    rows = [(k, {"brand": f"b{k % 5}", "type": None if k % 7 == 0 else f"t{k % 3}", **{f"x{i}": str(k) for i in range(k % 4)}}) for k in range(2**60, 2**60 + 40)]
    rows += rows[:1] * 4 + [(2**60 + 1, {"other": "y"}), (2**60 + 50, {}), (2**60 + 51, None), (None, {"brand": "b"})]
    spark.createDataFrame(rows, "id long, m map<string,string>").repartition(3).write.parquet(str(tmp_path / "maps"))
    held = {}
    for k, m in rows:
        if m:
            held.setdefault(k, []).append(m)
    for dim in (256, 100):
        made = hdc.encode_maps(spark.read.parquet(str(tmp_path / "maps")), "id", "m", dim)
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
        got = made.collect()
        assert len(got) == len(held) and {r.id: r.hv for r in got} == {k: [0] * -(-dim // 32) if k is None else _bundled(m, dim) for k, m in held.items()}


def test_hv_map_needs_no_broadcast(spark):
    made = registry.QUERIES["hv_map"](spark, SF)
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.mark for r in made.collect()} == {p.p_partkey: sum(_bundled([{"brand": p.p_brand, "type": p.p_type, "size": str(p.p_size)}], 256)) for p in parts}


def test_hv_query_map_needs_no_broadcast(spark, tmp_path):
    p = spark.read.parquet(f"{SF}/part.parquet")
    p.withColumn("p_type", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type"))).write.parquet(str(tmp_path / "part.parquet"))
    made = registry.QUERIES["hv_query_map"](spark, str(tmp_path))
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in spark.read.parquet(str(tmp_path / "part.parquet")).collect():
        asked = int("".join(f"{w:08x}" for w in reversed(_bundled([{"brand": r.p_brand, "type": r.p_type, "size": str(r.p_size)}], 256))), 16) ^ hdc._symbol("type", 256)
        want[r.p_partkey] = None if r.p_type is None else (asked ^ hdc._symbol(r.p_type, 256)).bit_count()
    assert {r.id: r.distance for r in made.collect()} == want and None in want.values()
