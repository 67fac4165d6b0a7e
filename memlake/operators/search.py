"""Vector, bit-vector, temporal, hybrid and keyword search: one projection and a top-k, without a shuffle of the texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import bits, scalar

ALPHA = 0.7


def _literal(words: list[int]) -> Column:
    return F.array(*(F.lit(w).cast("long") for w in words))


def search_dense(memories: DataFrame, query: list[float], k: int, where: Column | None = None, id_: str = "id", dense: str = "dense") -> DataFrame:
    """Top ``k`` by cosine; rows without a vector take no part, and the filter is honoured."""
    df = memories.where(F.col(dense).isNotNull())
    if where is not None:
        df = df.where(where)
    score = scalar.cosine(F.col(dense), F.array(*(F.lit(float(x)) for x in query)))
    return df.withColumn("score", score).where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), id_).limit(k)


def _ranked(memories: DataFrame, words: list[int], dim: int, as_of: Column) -> DataFrame:
    df = memories.withColumn("similarity", bits.similarity(F.col("hv"), _literal(words), dim))
    df = df.withColumn("strength", scalar.retention(F.col("base_retention"), F.col("last_recall"), F.col("stability"), as_of))
    return df.withColumn("score", ALPHA * F.col("similarity") + (1 - ALPHA) * F.col("strength"))


def search_bits(memories: DataFrame, words: list[int], dim: int, as_of: Column, k: int, id_: str = "id") -> DataFrame:
    """Top ``k`` by 0.7 similarity + 0.3 retention."""
    return _ranked(memories, words, dim, as_of).orderBy(F.desc("score"), id_).limit(k)


def search_threshold(memories: DataFrame, words: list[int], dim: int, as_of: Column, least: float, id_: str = "id") -> DataFrame:
    return _ranked(memories, words, dim, as_of).where(F.col("similarity") >= least).orderBy(F.desc("score"), id_)


def search_temporal(memories: DataFrame, words: list[int], dim: int, as_of: Column, k: int, since: Column | None = None, until: Column | None = None, id_: str = "id") -> DataFrame:
    """``search_bits`` over memories created within ``since`` and ``until``, both inclusive and optional."""
    if since is not None:
        memories = memories.where(F.col("created_at") >= since)
    if until is not None:
        memories = memories.where(F.col("created_at") <= until)
    return search_bits(memories, words, dim, as_of, k, id_)


def hybrid(a: DataFrame, b: DataFrame, alpha: float, k: int, id_: str = "id") -> DataFrame:
    """Fuse two scored sets (``id, score``); what one of them lacks scores 0 there."""
    both = a.select(id_, F.col("score").alias("_a")).join(b.select(id_, F.col("score").alias("_b")), id_, "full")
    return both.select(id_, (alpha * F.coalesce("_a", F.lit(0.0)) + (1 - alpha) * F.coalesce("_b", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), id_).limit(k)


def constrained(
    memories: DataFrame, as_of: Column, min_confidence: float | None = None, min_retention: float | None = None, include_consolidated: bool = True,
    sources: list[str] | None = None, since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """Memories that meet all constraints, with their ``strength``; both times are inclusive, and what is null meets none of those on it."""
    m = memories.withColumn("strength", scalar.retention(F.col("base_retention"), F.col("last_recall"), F.col("stability"), as_of))
    if min_confidence is not None:
        m = m.where(F.col("source.confidence") >= min_confidence)
    if min_retention is not None:
        m = m.where(F.col("strength") >= min_retention)
    if not include_consolidated:
        m = m.where(~F.col("is_consolidated"))
    if sources is not None:
        m = m.where(F.col("source.source_type").isin(sources))
    if since is not None:
        m = m.where(F.col("created_at") >= since)
    if until is not None:
        m = m.where(F.col("created_at") <= until)
    return m


def hybrid_search(a: DataFrame, b: DataFrame, memories: DataFrame, alpha: float, k: int, id_: str = "id") -> DataFrame:
    """The fused scores of two scored sets times retention, over ``memories`` (of ``constrained``) alone: the top ``k``, ties by id."""
    both = a.select(id_, F.col("score").alias("_a")).join(b.select(id_, F.col("score").alias("_b")), id_, "full")
    fused = alpha * F.coalesce("_a", F.lit(0.0)) + (1 - alpha) * F.coalesce("_b", F.lit(0.0))
    return both.join(memories.select(id_, "strength"), id_).select(id_, (fused * F.col("strength")).alias("score")).orderBy(F.desc("score"), id_).limit(k)


def bm25(texts: DataFrame, query: list[str], k: int, id_: str = "id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top ``k`` by BM25; only the query's terms are counted, so one pass reads the texts and one row a text is kept."""
    terms = sorted(set(query))
    toks = texts.select(id_, scalar.tokens(F.lower(text)).alias("_t"))
    tf = toks.select(id_, F.size("_t").alias("_n"), *(F.size(F.filter("_t", lambda x: x == t)).alias(f"_f{i}") for i, t in _pairs(terms)))
    whole = tf.agg(F.count("*").alias("n"), F.avg("_n").alias("avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (whole.n - whole[f"d{i}"] + 0.5) / (whole[f"d{i}"] + 0.5))
        f = F.col(f"_f{i}").cast("double")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.lit(whole.avg or 1.0)))
    return tf.select(id_, score.alias("score")).where("score > 0").orderBy(F.desc("score"), id_).limit(k)


def _pairs(terms: list[str]):
    return list(enumerate(terms))


def similar_structures(graphs: DataFrame, words: list[int], dim: int, least: float, id_: str = "id") -> DataFrame:
    """Encoded graphs at least ``least`` similar to an encoded subgraph."""
    return graphs.withColumn("similarity", bits.similarity(F.col("hv"), _literal(words), dim)).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), id_)
