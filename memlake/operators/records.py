"""Record logs: the state that a log of versions and tombstones stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: list[str], deleted: str) -> DataFrame:
    """The last version by ``order`` of every ``key`` whose last entry is no tombstone, without ``order`` and ``deleted``.

    One aggregation with partial maxima: a key with very many versions is reduced before the shuffle.
    """
    keep = [c for c in log.columns if c not in {key, deleted, *order}]
    last = log.groupBy(key).agg(F.max_by(F.struct(F.col(deleted).alias("_gone"), *keep), F.struct(*order)).alias("_v"))
    return last.where("not _v._gone").select(key, *(F.col(f"_v.{c}").alias(c) for c in keep))


def versions(log: DataFrame, key: str, deleted: str) -> DataFrame:
    """Per ``key``: how many versions were written and how often it was deleted."""
    return log.groupBy(key).agg(F.count_if(~F.col(deleted)).alias("written"), F.count_if(deleted).alias("deletions"))


def missing(ids: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """The ids that an update or deletion would not find."""
    return ids.select(key).distinct().join(known.select(key), key, "left_anti")


def paged(rows: DataFrame, after: Column | None, size: int, key: str = "id") -> DataFrame:
    """The next ``size`` rows by ``key`` after a given one: the filter is pushed down to the files."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)
