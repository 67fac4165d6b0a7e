"""The façade: one method for each request that a memory service answers, DataFrames in and out, ``as_of`` explicit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import bits, scalar
from memlake.operators import hdc, memory, search
from memlake.sources.config import Config
from memlake.sources.store import EventLog, InvalidOperation, MemoryStore, NotFound, columnar, new_intention, new_text, parse_trigger

__all__ = ["Engine", "InvalidOperation", "NotFound", "columnar", "new_intention", "new_text", "parse_trigger"]


class Engine:
    """Reads that are given a time ``ts`` count as recalls: they are appended to the event log, and ``state`` folds them into
    access counts, stability, retention and last recall. Sequence numbers go on from the greatest one stored."""

    def __init__(self, store: MemoryStore, config: Config | None = None, dim: int = 10_016) -> None:
        self.store, self.config, self.dim = store, config or Config(), dim
        self.log = EventLog(store.spark, store.path.rstrip("/") + "-events")
        self._seq: int | None = None

    def initialize(self) -> None:
        self.store.initialize()
        self.log.initialize()

    def _next(self) -> int:
        if self._seq is None:
            self._seq = self.store._log().agg(F.coalesce(F.max("_seq"), F.lit(0))).first()[0]
        self._seq += 1
        return self._seq

    def _one(self, id_: str | None) -> DataFrame:
        return self.store.spark.createDataFrame([(id_,)], "id string")

    def state(self) -> DataFrame:
        """The latest version of every memory, with all its recalls since it was created."""
        now = self.store.state()
        recalls = self.log.read().where("op = 'recall_ok'").join(now.select("id", F.col("created_at").alias("_from")), "id").where(F.col("ts") >= F.col("_from"))
        n = recalls.groupBy("id").agg(F.count("*").alias("_n"), F.max("ts").alias("_at"))
        now = now.join(n, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        last = lambda c: F.greatest(F.col(c), F.col("_at"))
        base = F.when(F.col("_n") > 0, F.least(F.lit(1.0), F.col("base_retention") * F.pow(F.lit(scalar.BASE_GAIN), F.col("_n")))).otherwise(F.col("base_retention"))
        new = {"access_count": F.col("access_count") + F.col("_n"), "stability": F.col("stability") * F.pow(F.lit(scalar.RECALL_OK), F.col("_n")), "base_retention": base, "last_recall": last("last_recall"), "last_accessed": last("last_accessed")}
        return now.withColumns({k: v.cast(now.schema[k].dataType) for k, v in new.items()}).drop("_n", "_at")

    def add(self, memories: DataFrame, ts: Column) -> None:
        """Ingest: bit vectors are encoded where there are none; text-less memories encode their metadata."""
        if self.config.auto_hdc_encoding:
            text = F.coalesce("text", F.to_json("metadata"))
            coded = hdc.encode_texts(memories.where("hdc is null").withColumn("_t", text), "id", "_t", self.dim)
            memories = memories.join(coded, "id", "left").withColumn("hdc", F.coalesce("hdc", "hv")).drop("hv")
        self.store.store(memories, ts, self._next())
        self.log.append("add", memories, ts, self._next())

    def add_intention(self, rows: DataFrame, ts: Column) -> None:
        """Ingest intentions ``id, goal, trigger, priority, source``."""
        self.add(new_intention(rows, ts), ts)

    def get(self, id_: str, ts: Column | None = None) -> DataFrame:
        found = self.state().where(F.col("id") == id_)
        if found.isEmpty():
            raise NotFound(id_)
        if ts is not None:
            self.log.append("recall_ok", self._one(id_), ts, self._next())
        return found

    def delete(self, ids: DataFrame, ts: Column) -> None:
        self.store.delete(ids, ts, self._next())

    def search(self, query: str, k: int, as_of: Column, since: Column | None = None, until: Column | None = None, ts: Column | None = None) -> DataFrame:
        rows = self.state().withColumnRenamed("hdc", "hv").where("hv is not null")
        found = search.search_temporal(rows, hdc.encode_text(query, self.dim), self.dim, as_of, min(k, self.config.max_search_results), since, until)
        if ts is not None:  # a search, and a recall of each of its few results
            hits = self.store.spark.createDataFrame(found.select("id").collect(), "id string")
            self.log.append("search", self._one(None), ts, self._next())
            self.log.append("recall_ok", hits, ts, self._next())
        return found

    def stats(self) -> DataFrame:
        """Counters of the event log."""
        return memory.stats(self.log.read())

    def consolidate(self, ids: DataFrame, ts: Column) -> None:
        self.store.update(memory.consolidate(self.store.state(), ids).join(ids.select("id").distinct(), "id", "left_semi"), ts, self._next())
        self.log.append("consolidate", ids.select("id").distinct(), ts, self._next())

    def candidates(self, strategy: str, as_of: Column, threshold: float) -> DataFrame:
        """``id, score, reason`` of the memories that a strategy (access, retention, temporal, cluster) would consolidate; clusters name none."""
        m = self.state()
        if strategy not in ("access", "retention", "temporal", "cluster"):
            raise InvalidOperation(f"{strategy} is no strategy")
        if strategy == "cluster":
            return self.store.spark.createDataFrame([], "id string, score double, reason string")
        found = memory.by_access(m, threshold) if strategy == "access" else memory.by_retention(m, as_of, threshold) if strategy == "retention" else memory.by_age(m, as_of, threshold)
        return found.select("id", "score", "reason")

    def maintain(self, as_of: dt.datetime, forgot: dt.datetime, consolidated: dt.datetime) -> tuple[bool, bool]:
        """Forget and consolidate where the settings ask for it and the last runs are an interval ago; whether either ran."""
        c, now = self.config, F.lit(as_of)
        forget = c.background_forgetting and (as_of - forgot).total_seconds() >= c.forgetting_interval_s
        merge = c.background_consolidation and (as_of - consolidated).total_seconds() >= c.consolidation_interval_s
        if forget:
            self.forget(now, now)
        if merge and not (ids := self.candidates("retention", now, 0.7).select("id")).isEmpty():
            self.consolidate(ids, now)
        return forget, merge

    def search_emotion(self, valence: str, k: int, as_of: Column) -> DataFrame:
        return memory.search_emotion(self.state(), as_of, valence, min(k, self.config.max_search_results))

    def search_affect(self, target: Column, k: int, most: float) -> DataFrame:
        return memory.search_affect(self.store.state().where("pad is not null"), target, min(k, self.config.max_search_results), most)

    def update_emotion(self, moods: DataFrame, ts: Column) -> None:
        """New moods ``id, pad`` of memories: the state's history grows by one."""
        rows = self.store.state().drop("pad", "valence").join(moods.select("id", "pad"), "id")
        known = F.coalesce("mood_history", F.array().cast(self.store.state().schema["mood_history"].dataType))
        rows = rows.withColumn("mood_history", F.concat(known, F.array(F.struct(ts.alias("ts"), F.col("pad"))))).withColumn("valence", scalar.valence(F.col("pad.pleasure")))
        self.store.update(rows, ts, self._next())

    def emotion_stats(self) -> DataFrame:
        return memory.emotion_stats(self.store.state())

    def _intentions(self) -> DataFrame:
        i = F.col("intention")
        return self.store.state().where("intention is not null").select("*", i["status"].alias("status"), i["priority"].alias("priority"), i["trigger"]["kind"].alias("kind"), i["trigger"]["at"].alias("at"))

    def active_intentions(self) -> DataFrame:
        return memory.active_intentions(self._intentions())

    def triggerable_intentions(self, as_of: Column) -> DataFrame:
        return memory.triggerable(self._intentions(), as_of)

    def set_status(self, id_: str, status: str, ts: Column) -> None:
        row = self.store.retrieve(id_)
        if row.where("intention is not null").isEmpty():
            raise InvalidOperation(f"{id_} is no intention")
        changed = F.col("intention").withField("status", F.lit(status)).withField("completed_at", ts)
        self.store.update(row.withColumn("intention", changed), ts, self._next())

    def complete(self, id_: str, ts: Column) -> None:
        self.set_status(id_, "Completed", ts)

    def cancel(self, id_: str, ts: Column) -> None:
        self.set_status(id_, "Cancelled", ts)

    def forget(self, as_of: Column, ts: Column, threshold: float | None = None) -> int:
        """Tombstones for all weak memories, in one append; how many."""
        gone = memory.weak(self.state(), as_of, self.config.forgetting_threshold if threshold is None else threshold).select("id")
        n = gone.count()
        if n:
            self.store._append(gone, ts, self._next(), True)
        self.log.append("forget", self._one(None), ts, self._next(), n)
        return n

    def responses(self, as_of: Column) -> DataFrame:
        return memory.response(self.state().withColumn("goal", F.col("intention.goal")), as_of)

    def similarity(self, a: Column, b: Column) -> Column:
        return bits.similarity(a, b, self.dim)
