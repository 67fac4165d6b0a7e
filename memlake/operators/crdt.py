"""Vector-clocked facts and last-writer-wins sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import scalar


def clocks(events: DataFrame, keys: list[str], node: str) -> DataFrame:
    """``clock`` of each key: how many events each node has."""
    n = events.groupBy(*keys, F.col(node).alias("_node")).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_node", "_n")))).alias("clock"))


def merge_clocks(rows: DataFrame, keys: list[str], clock: str = "clock") -> DataFrame:
    """The pointwise maximum of all clocks of each key."""
    each = rows.select(*keys, F.explode(clock).alias("_node", "_n")).groupBy(*keys, "_node").agg(F.max("_n").alias("_n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_node", "_n")))).alias("clock"))


def merged_wins(a_clock: Column, a_lamport: Column, a_id: Column, b_clock: Column, b_lamport: Column, b_id: Column) -> Column:
    """Whether the first of two facts survives their merge: by clock, then Lamport time, then id."""
    order = scalar.clock_order(a_clock, b_clock)
    tie = F.struct(a_lamport.alias("l"), a_id.alias("i")) > F.struct(b_lamport.alias("l"), b_id.alias("i"))
    return F.when(order == "greater", True).when(order == "less", False).otherwise(tie)


def supersedes(a_clock: Column, a_supersedes: Column, b_clock: Column, b_id: Column) -> Column:
    return F.coalesce(a_supersedes == b_id, F.lit(False)) | (scalar.clock_order(a_clock, b_clock) == "greater")


def merge_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One fact of each key: the versions that no other dominates, then the greatest (lamport, id). Order-free.

    Versions with equal clocks count once (the greatest of them), so a key's many copies of one clock do not pair up.
    """
    canon = F.array_sort(F.map_entries("clock"))
    one = facts.groupBy(*keys, canon.alias("_c")).agg(F.max_by(F.struct(*[c for c in facts.columns if c not in keys]), F.struct("lamport", "id")).alias("_f"))
    a = one.select(*keys, "_c", "_f")
    b = one.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_f.clock").alias("_other"))
    same = F.lit(True)
    for k in keys:
        same &= a[k] == b[f"_{k}"]
    kept = a.join(b, same & (scalar.clock_order(b["_other"], a["_f.clock"]) == "greater"), "left_anti")
    return kept.groupBy(*keys).agg(F.max_by("_f", F.struct("_f.lamport", "_f.id")).alias("_f")).select(*keys, "_f.*")


def lww(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Elements present after ``op, ts`` rows (add or remove): added last; a tie means removed."""
    t = lambda op: F.max(F.when(F.col("op") == op, F.col("ts"))).alias(op)
    g = ops.groupBy(*keys).agg(t("add"), t("remove"))
    return g.where(F.col("add").isNotNull() & (F.col("remove").isNull() | (F.col("add") > F.col("remove"))))


def new_facts(rows: DataFrame, node: str, created_at: Column) -> DataFrame:
    """First versions of facts from ``id, subject, predicate, object, confidence, sources``, made by ``node``: clock and Lamport time 1."""
    null = F.lit(None).cast("string")
    return rows.select(
        "id", "subject", "predicate", "object", F.create_map(F.lit(node), F.lit(1).cast("long")).alias("vector_clock"), F.lit(1).cast("long").alias("lamport"), "confidence", "sources",
        null.alias("supersedes"), created_at.alias("created_at"), F.lit(node).alias("created_by"), F.lit(False).alias("is_derived"), F.array().cast("array<string>").alias("tags"),
    )
