"""The property graph: ``nodes(id, labels, properties)`` and ``edges(src, dst, relationship, properties)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist; duplicates stay."""
    ids = nodes.select(F.col("id"))
    return edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")


def rejected_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that lack an end (an anti join of each side, each edge once)."""
    ids = nodes.select(F.col("id"))
    no_src = edges.join(ids, edges.src == ids.id, "left_anti")
    return no_src.unionByName(edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_anti"))


def neighbors(edges: DataFrame, start: str, depth: int, relationships: list[str] | None = None, direction: str = "out") -> DataFrame:
    """``id, hops``: nodes within ``depth`` hops of ``start`` at their least distance, without ``start``.

    The filter holds on every hop. Each hop is one join of the nodes that walks of its length end at with the edges, so
    the plan grows by one join a hop and hops share their exchanges; a node's least hop counts. Nodes met again are walked on
    from, which adds no more than one pass over the edges a hop.
    """
    if relationships:
        edges = edges.where(F.col("relationship").isin(relationships))
    step = edges.select("src", "dst")
    if direction == "both":
        step = step.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    elif direction == "in":
        step = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    met = edges.sparkSession.createDataFrame([], "id string, hops int")
    for hop in range(1, depth + 1):
        ends = step.where(F.col("src") == start) if hop == 1 else step.join(ends.withColumnRenamed("id", "src"), "src", "left_semi")
        ends = ends.select(F.col("dst").alias("id")).distinct()
        met = met.union(ends.withColumn("hops", F.lit(hop)))
    return met.where(~F.col("id").eqNullSafe(F.lit(start))).groupBy("id").agg(F.min("hops").alias("hops"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when ``ids`` go: edges go with either end."""
    gone = ids.select("id").distinct()
    left = edges.join(gone, edges.src == gone.id, "left_anti").join(gone, edges.dst == gone.id, "left_anti")
    return nodes.join(gone, "id", "left_anti"), left


def latest_nodes(log: DataFrame) -> DataFrame:
    """The last version (``ts, seq``) of each node of an append-only log."""
    return log.groupBy("id").agg(F.max_by(F.struct("labels", "properties"), F.struct("ts", "seq")).alias("_v")).select("id", "_v.*")


def query(nodes: DataFrame, edges: DataFrame, text: str, **params) -> DataFrame:
    """SQL over ``{nodes}`` and ``{edges}``, with named parameters (``:name``)."""
    return nodes.sparkSession.sql(text, args=params, nodes=nodes, edges=edges)
