"""Graph queries over regions, nations, customers and suppliers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from memlake.functions import scalar
from memlake.operators import graph

PLANS: dict = {}
_NODES = "SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier"
_EDGES = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'nation' AS relationship FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'region' FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'supplier' FROM supplier"
# The edges of customers in debt dangle in the two queries about edges whose nodes are missing.
_KNOWN = _NODES.replace("FROM customer", "FROM customer WHERE c_acctbal >= 0")
_WITH = f"WITH nodes AS ({_NODES}), edges AS ({_EDGES}) "


def tables(spark, d, nodes=_NODES):
    for t in ("region", "nation", "customer", "supplier"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"memlake_{t}")
    fix = lambda q: re.sub(r"FROM (\w+)", r"FROM memlake_\1", q)
    return spark.sql(fix(nodes)), spark.sql(fix(_EDGES))


def plan(name, sql):
    def add(f):
        PLANS[name] = (f, sql if sql.startswith("WITH") else (_WITH.replace(_NODES, _KNOWN) if name.startswith("gr_edge_") else _WITH) + sql)
        return f

    return add


def _hops(depth, where="true"):
    cols = f"WITH RECURSIVE nodes AS ({_NODES}), edges AS (SELECT * FROM ({_EDGES}) WHERE {where}), w AS (SELECT 'r1' AS id, 0 AS hops UNION SELECT e.dst, w.hops + 1 FROM w JOIN edges e ON e.src = w.id WHERE w.hops < {depth}) "
    return cols + "SELECT id, CAST(min(hops) AS INT) AS hops FROM w GROUP BY id HAVING min(hops) > 0"


for _depth in (1, 2, 3):
    PLANS[f"gr_neighbors_d{_depth}"] = ((lambda n: lambda spark, d: graph.neighbors(tables(spark, d)[1], "r1", n))(_depth), _hops(_depth))


@plan("gr_rel_filter", _hops(3, "relationship IN ('region', 'supplier')"))
def _(spark, d):
    return graph.neighbors(tables(spark, d)[1], "r1", 3, ["region", "supplier"])


@plan("gr_delete_cascade", "SELECT relationship, count(*) AS n_edges, (SELECT count(*) FROM nodes WHERE id NOT IN ('r1', 'n3', 'n7')) AS n_nodes FROM edges WHERE src NOT IN ('r1', 'n3', 'n7') AND dst NOT IN ('r1', 'n3', 'n7') GROUP BY relationship")
def _(spark, d):
    nodes, edges = graph.delete_nodes(*tables(spark, d), spark.createDataFrame([("r1",), ("n3",), ("n7",)], "id string"))
    left = nodes.agg(F.count("*").alias("n_nodes"))
    return edges.groupBy("relationship").agg(F.count("*").alias("n_edges")).crossJoin(F.broadcast(left))


@plan("gr_edge_reject", "SELECT src, dst, relationship FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)")
def _(spark, d):
    return graph.rejected_edges(*tables(spark, d, _KNOWN))


@plan("gr_edge_create", "SELECT relationship, count(*) AS n FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY relationship")
def _(spark, d):
    return graph.valid_edges(*tables(spark, d, _KNOWN)).groupBy("relationship").agg(F.count("*").alias("n"))


@plan("gr_counts", "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def _(spark, d):
    nodes, edges = tables(spark, d)
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edge_count"))))


@plan("gr_edge_ids", "SELECT DISTINCT src || '-' || relationship || '-' || dst AS edge_id FROM edges")
def _(spark, d):
    return tables(spark, d)[1].select(scalar.edge_id(F.col("src"), F.col("relationship"), F.col("dst")).alias("edge_id")).distinct()


@plan("gr_upsert", "SELECT id, CASE WHEN substr(id, 1, 1) = 'n' THEN 'two' ELSE 'one' END AS label FROM nodes")
def _(spark, d):
    nodes = tables(spark, d)[0]
    first = nodes.select("id", F.lit(1).alias("seq"), F.lit("one").alias("l"))
    log = first.union(nodes.where("id like 'n%'").select("id", F.lit(2), F.lit("two")))
    log = log.select("id", "seq", F.expr("TIMESTAMP '2024-01-01'").alias("ts"), F.array("l").alias("labels"), F.create_map(F.lit("a"), F.col("l")).alias("properties"))
    return graph.latest_nodes(log).select("id", F.col("labels")[0].alias("label"))


@plan("gr_properties", "SELECT 'c' || c_custkey AS id, '{\"segment\":\"' || c_mktsegment || '\"}' AS properties FROM customer")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.to_json(F.create_map(F.lit("segment"), "c_mktsegment")).alias("properties"))


@plan("gr_get_node", "SELECT id, 'region' AS label FROM nodes WHERE id = 'r1'")
def _(spark, d):
    """One node with its label, by id."""
    return tables(spark, d)[0].where("id = 'r1'").select("id", F.lit("region").alias("label"))


@plan("gr_query", "SELECT e.relationship, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = 'n3' GROUP BY e.relationship")
def _(spark, d):
    return graph.query(*tables(spark, d), "SELECT e.relationship, count(*) AS n FROM {edges} e JOIN {nodes} n ON n.id = e.dst WHERE e.src = :src GROUP BY e.relationship", src="n3")
