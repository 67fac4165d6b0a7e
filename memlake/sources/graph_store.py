"""The graph store: append-only Parquet logs of nodes and edges under one path, read as their latest state.

A node's last version counts. Deleting a node writes its tombstone, which hides all edges of either end written before it;
edges are never rewritten. Every write takes the time and a sequence number, as in the memory store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import graph

from . import schemas
from .store import MemoryStore, NotFound


class GraphStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        base = path.rstrip("/")
        self.spark = spark
        self._nodes, self._edges = MemoryStore(spark, base + "/nodes", schemas.NODES), MemoryStore(spark, base + "/edges", schemas.EDGES)

    def initialize(self) -> None:
        self._nodes.initialize()
        self._edges.initialize()

    def nodes(self) -> DataFrame:
        return self._nodes.state()

    def edges(self) -> DataFrame:
        """Edges that no later deletion of an end hides; equal edges stay apart."""
        log = self._edges._log()
        gone = self._nodes._log().where("_deleted").groupBy("id").agg(F.max(F.struct("_ts", "_seq")).alias("_gone"))
        at = F.struct(F.col("_ts"), F.col("_seq"))
        for end in ("src", "dst"):
            log = log.join(gone, (log[end] == gone.id) & (at < gone["_gone"]), "left_anti")
        return log.drop("_ts", "_seq", "_deleted")

    def create_nodes(self, nodes: DataFrame, ts: Column, seq: int) -> None:
        """Insert or replace nodes ``id, labels, properties``."""
        self._nodes.store(nodes, ts, seq)

    def get_node(self, id_: str) -> DataFrame:
        return self._nodes.retrieve(id_)

    def create_edges(self, edges: DataFrame, ts: Column, seq: int) -> None:
        """Append edges whose ends exist; if any lacks an end, none is written."""
        bad = graph.rejected_edges(self.nodes(), edges).first()
        if bad:
            raise NotFound(f"{bad.src} or {bad.dst}")
        self._edges.store(edges, ts, seq)

    def delete_node(self, id_: str, ts: Column, seq: int) -> None:
        self._nodes.delete(self.spark.createDataFrame([(id_,)], "id string"), ts, seq)

    def neighbors(self, id_: str, depth: int, relationships: list[str] | None = None, direction: str = "out") -> DataFrame:
        return graph.neighbors(self.edges(), id_, depth, relationships, direction)

    def query(self, text: str, **params) -> DataFrame:
        """SQL over ``{nodes}`` and ``{edges}``, with named parameters (``:name``)."""
        return graph.query(self.nodes(), self.edges(), text, **params)

    def counts(self) -> DataFrame:
        return self.nodes().agg(F.count("*").alias("node_count")).crossJoin(F.broadcast(self.edges().agg(F.count("*").alias("edge_count"))))  # one row each
