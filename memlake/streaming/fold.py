"""The event-log fold as Structured Streaming; the closed form makes it an ordinary aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from memlake.operators import memory


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fold_recalls(events: DataFrame, key: str, base0: Column, ok: Column, failed: Column) -> DataFrame:
    """The batch fold, unchanged: counts, extremes and closed forms update as events arrive, in any order."""
    return memory.fold_recalls(events, key, base0, ok, failed)


def start(folded: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return folded.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
