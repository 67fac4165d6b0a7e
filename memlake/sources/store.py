"""The memory store: an append-only Parquet log of versions and tombstones, read as its latest state.

Writes only append, so a lost task is written anew and readers see whole files. Deletes are tombstones,
updates are later versions; ``compact`` rewrites the folded state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import scalar
from memlake.operators import records

from . import schemas


class NotFound(KeyError):
    """No memory or node with this id."""


class InvalidOperation(ValueError):
    """An operation that the record does not support."""


def new_text(rows: DataFrame, created_at: Column) -> DataFrame:
    """Memories with the defaults of text from ``id, text, source``; base retention is the source's confidence."""
    null = lambda t: F.lit(None).cast(t)
    given = {
        "id": F.col("id"), "modality": F.lit("Text"), "content": F.encode("text", "UTF-8"), "text": F.col("text"), "created_at": created_at, "last_accessed": created_at, "access_count": F.lit(0), "is_consolidated": F.lit(False),
        "base_retention": F.col("source.confidence"), "decay_rate": F.lit(schemas.DECAY_RATE), "stability": F.lit(schemas.STABILITY), "last_recall": created_at, "recall_count": F.lit(0), "source": F.col("source"),
    }
    if "pad" in rows.columns:
        given |= {"pad": scalar.pad(F.col("pad.pleasure"), F.col("pad.arousal"), F.col("pad.dominance")), "valence": scalar.valence(scalar.clamp(F.col("pad.pleasure"), -1.0, 1.0))}
    wanted = [f.split(" ", 1) for f in _fields(schemas.MEMORIES)]
    return rows.select(*(given.get(n, null(t)).cast(t).alias(n) for n, t in wanted))


def new_intention(rows: DataFrame, created_at: Column) -> DataFrame:
    """Memories of intentions from ``id, goal, trigger, priority, source``: pending, base retention 1, priority clamped."""
    df = new_text(rows.withColumn("text", F.col("goal")), created_at)
    intent = rows.select(F.col("id").alias("_i"), F.struct("goal", F.col("trigger"), F.lit(None).cast("timestamp").alias("deadline"), scalar.clamp(F.col("priority"), 0.0, 1.0).alias("priority"), F.lit("Pending").alias("status"), created_at.alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at")).alias("_intent"))
    df = df.join(intent, df.id == intent._i).drop("_i")
    kind = dict(f.split(" ", 1) for f in _fields(schemas.MEMORIES))["intention"]
    return df.withColumn("intention", F.col("_intent").cast(kind)).withColumn("base_retention", F.lit(1.0)).withColumn("modality", F.lit("Structured")).drop("_intent")


def parse_trigger(text: Column) -> Column:
    """A trigger struct from tagged JSON; null kind where the type is unknown or its date does not parse."""
    j = F.from_json(text, schemas.TRIGGER)
    names = {"immediate": "Immediate", "time_based_at": "TimeBasedAt", "time_based_after": "TimeBasedAfter", "event_based": "EventBased", "context_based": "ContextBased"}
    kind = F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.coalesce(j["type"], F.lit("")))
    at = F.try_to_timestamp(j["datetime"])
    kind = F.when((kind == "TimeBasedAt") & at.isNull(), F.lit(None)).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.coalesce(j["type"], F.lit(""))))
    return F.struct(kind.alias("kind"), at.alias("at"), j["duration_seconds"].alias("after_s"), j["event"].alias("event"), j["contexts"].alias("contexts"))


def _fields(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]


class MemoryStore:
    """Versions of memories under ``path``; every write is one append with a sequence number given by the caller's clock."""

    def __init__(self, spark: SparkSession, path: str, schema: str = schemas.MEMORIES) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def initialize(self) -> None:
        self._empty().write.mode("ignore").parquet(self.path)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.schema}, _ts timestamp, _seq bigint, _deleted boolean")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(self._empty().schema).parquet(self.path)

    def _append(self, df: DataFrame, ts: Column, seq: int, deleted: bool) -> None:
        wanted = self.spark.createDataFrame([], self.schema)
        rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.schema))
        rows.withColumns({"_ts": ts, "_seq": F.lit(seq).cast("long"), "_deleted": F.lit(deleted)}).write.mode("append").parquet(self.path)

    def store(self, memories: DataFrame, ts: Column, seq: int = 0) -> None:
        """Insert or replace by id."""
        self._append(memories, ts, seq, False)

    def update(self, memories: DataFrame, ts: Column, seq: int = 0) -> None:
        missing = memories.select("id").join(self.state().select("id"), "id", "left_anti").first()
        if missing:
            raise NotFound(missing.id)
        self._append(memories, ts, seq, False)

    def delete(self, ids: DataFrame, ts: Column, seq: int = 0) -> None:
        missing = ids.select("id").join(self.state().select("id"), "id", "left_anti").first()
        if missing:
            raise NotFound(missing.id)
        self._append(ids.select("id"), ts, seq, True)

    def state(self) -> DataFrame:
        """The latest version of every memory that is not deleted."""
        return records.latest(self._log(), "id", ["_ts", "_seq"], "_deleted")

    def retrieve(self, id_: str) -> DataFrame:
        """One memory; the id is pushed down to the files. Reading changes nothing."""
        found = self.state().where(F.col("id") == id_)
        if found.isEmpty():
            raise NotFound(id_)
        return found

    def list_ids(self) -> DataFrame:
        return self.state().select("id")

    def is_empty(self) -> bool:
        return self.state().isEmpty()

    def __len__(self) -> int:
        return self.state().count()

    def stats(self) -> DataFrame:
        return self.state().agg(F.count("*").alias("memories"))

    def compact(self, path: str, ts: Column) -> MemoryStore:
        fresh = MemoryStore(self.spark, path, self.schema)
        fresh.store(self.state(), ts)
        return fresh


class EventLog:
    """What was done, append-only: ``op, id, n, ts, seq``."""

    SCHEMA = "op string, id string, n bigint, ts timestamp, seq bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def initialize(self) -> None:
        self.spark.createDataFrame([], self.SCHEMA).write.mode("ignore").parquet(self.path)

    def append(self, op: str, ids: DataFrame, ts: Column, seq: int, n: int | None = None) -> None:
        """One event for each row of ``ids`` (``id``)."""
        ids.select(F.lit(op).alias("op"), F.col("id").cast("string").alias("id"), F.lit(n).cast("long").alias("n"), ts.alias("ts"), F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)


def columnar(memories: DataFrame, as_of: Column) -> DataFrame:
    """The 14 storage columns, with strength as of the write and metadata as JSON."""
    m = F.col
    strength = scalar.retention(m("base_retention"), m("last_recall"), m("stability"), as_of)
    return memories.select(
        "id", "modality", "content", "text", m("dense").alias("dense_vector"), m("hdc").alias("hdc_vector"), F.unix_millis("created_at").alias("created_at"), F.unix_millis("last_accessed").alias("last_accessed"), "access_count",
        "is_consolidated", strength.cast("float").alias("retention_strength"), m("source.source_type").alias("source_type"), m("source.confidence").cast("float").alias("confidence"), F.to_json("metadata").alias("metadata"),
    )


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table of any built-in format (parquet, orc, json, csv, avro or jdbc where their packages are there)."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", partition_by: list[str] | None = None) -> None:
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
