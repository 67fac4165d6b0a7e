"""Retention, affect and intention operators over the memory table, and the fold of its event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import scalar


def with_strength(memories: DataFrame, as_of: Column) -> DataFrame:
    """Add ``strength`` from ``base_retention, last_recall, stability``."""
    return memories.withColumn("strength", scalar.retention(F.col("base_retention"), F.col("last_recall"), F.col("stability"), as_of))


def weak(memories: DataFrame, as_of: Column, threshold: float) -> DataFrame:
    """Memories to forget: strength strictly below the threshold."""
    return with_strength(memories, as_of).where(F.col("strength") < threshold)


def survivors(memories: DataFrame, as_of: Column, threshold: float) -> DataFrame:
    return with_strength(memories, as_of).where(F.col("strength") >= threshold)


def forget(memories: DataFrame, as_of: Column, retention_below: float | None = None, older_than: Column | None = None, source_type: str | None = None) -> DataFrame:
    """Memories that meet all criteria given; none given: none."""
    df, tests = with_strength(memories, as_of), []
    if retention_below is not None:
        tests.append(F.col("strength") < retention_below)
    if older_than is not None:
        tests.append(F.col("created_at") < older_than)
    if source_type is not None:
        tests.append(F.col("source_type") == source_type)
    test = F.lit(bool(tests))
    for t in tests:
        test &= t
    return df.where(test)


def active_top(memories: DataFrame, as_of: Column, threshold: float, k: int, id_: str = "id") -> DataFrame:
    return with_strength(memories, as_of).where(F.col("strength") > threshold).orderBy(F.desc("recall_count"), id_).limit(k)


def reviews(memories: DataFrame, threshold: float) -> DataFrame:
    """Add ``forget_at``; rows that are below the threshold already are left out."""
    at = scalar.forget_time(F.col("base_retention"), F.col("last_recall"), F.col("stability"), F.lit(threshold))
    return memories.withColumn("forget_at", at).where("forget_at is not null")


def fold_recalls(events: DataFrame, key: str, base0: Column, ok: Column, failed: Column, consolidated: Column | None = None) -> DataFrame:
    """State after all recalls of each key in closed form: no order is needed, so partial aggregation applies.

    ``base0`` is the base before (the same for all rows of a key), ``ok`` and ``failed`` mark recalls, ``ts`` is their time.
    """
    done = F.count_if(consolidated) if consolidated is not None else F.lit(0)
    g = events.groupBy(key).agg(F.count_if(ok).alias("n_ok"), F.count_if(failed).alias("n_fail"), done.alias("n_cons"), F.max(F.when(ok | failed, F.col("ts"))).alias("last_recall"), F.max(base0).alias("_b"))
    base = F.when(F.col("n_ok") > 0, F.least(F.lit(1.0), F.col("_b") * F.pow(F.lit(scalar.BASE_GAIN), F.col("n_ok")))).otherwise(F.col("_b"))
    stability = F.pow(F.lit(scalar.RECALL_OK), F.col("n_ok") + F.col("n_cons")) * F.pow(F.lit(scalar.RECALL_FAIL), F.col("n_fail"))
    return g.select(key, F.col("n_ok").alias("recall_count"), (F.col("n_ok") + F.col("n_fail")).alias("access_count"), stability.alias("stability"), base.alias("base_retention"), "last_recall")


def fold_emotions(events: DataFrame, key: str) -> DataFrame:
    """Current ``pad``, its ``valence`` and the length of the history of each key, from rows with ``ts, seq, pad``."""
    g = events.groupBy(key).agg(F.max_by("pad", F.struct("ts", "seq")).alias("pad"), F.count("*").alias("n_moods"))
    return g.withColumn("valence", scalar.valence(F.col("pad.pleasure")))


def mood_history(events: DataFrame, key: str) -> DataFrame:
    """The moods of each key in order; one key's history is held in one row, as the record has it."""
    return events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "pad"))).alias("mood_history"))


def search_emotion(memories: DataFrame, as_of: Column, wanted: str, k: int, id_: str = "id") -> DataFrame:
    return with_strength(memories.where(F.col("valence") == wanted), as_of).orderBy(F.desc("strength"), id_).limit(k)


def search_affect(memories: DataFrame, target: Column, k: int, most: float, id_: str = "id") -> DataFrame:
    """The nearest moods within ``most`` (inclusive)."""
    return memories.withColumn("distance", scalar.pad_distance(F.col("pad"), target)).where(F.col("distance") <= most).orderBy("distance", id_).limit(k)


def emotion_stats(memories: DataFrame) -> DataFrame:
    m = memories.where("pad is not null")
    return m.agg(*(F.count_if(F.col("valence") == v).alias(f"n_{v}") for v in ("positive", "negative", "neutral")), F.coalesce(F.avg(scalar.intensity(F.col("pad"))), F.lit(0.0)).alias("avg_intensity"))


def active_intentions(intentions: DataFrame, id_: str = "id") -> DataFrame:
    return intentions.where(scalar.is_active(F.col("status"))).orderBy(F.desc("priority"), id_)


def triggerable(intentions: DataFrame, as_of: Column, id_: str = "id", **given) -> DataFrame:
    return intentions.where(scalar.should_trigger(F.col("status"), F.col("kind"), F.col("at"), as_of, **given)).orderBy(F.desc("priority"), id_)


def fold_statuses(events: DataFrame, key: str) -> DataFrame:
    """The last ``status`` of each key and when it was completed or cancelled."""
    g = events.groupBy(key).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("_t"))
    return g.select(key, "status", F.when(F.col("status").isin("Completed", "Cancelled"), F.col("_t")).alias("completed_at"))


def stats(events: DataFrame) -> DataFrame:
    """Counters derived from the event log (``op``, and ``n`` for forget runs)."""
    count = lambda op, name: F.count_if(F.col("op") == op).alias(name)
    last = F.max_by(F.when(F.col("op") == "forget", F.col("n")), F.when(F.col("op") == "forget", F.struct("ts", "seq")))
    return events.agg(count("add", "total_memories"), count("search", "total_searches"), F.coalesce(F.sum(F.when(F.col("op") == "forget", F.col("n"))), F.lit(0)).alias("total_forgotten"), F.coalesce(last, F.lit(0)).alias("last_forgotten"), count("conflict", "conflicts_resolved"), count("consolidate", "consolidations"), count("recall_ok", "recalls"))


def response(memories: DataFrame, as_of: Column) -> DataFrame:
    """The canonical projection of a memory that callers see."""
    m = with_strength(memories, as_of)
    return m.select("id", "text", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "access_count", F.col("strength").alias("retention_strength"), "valence", F.col("goal").isNotNull().alias("is_prospective"))


def by_access(memories: DataFrame, threshold: float) -> DataFrame:
    """Candidates for consolidation by use: at least 5 accesses, score of at most 1."""
    score = F.least(F.col("access_count"), F.lit(10)) / 10.0
    m = memories.where((F.col("access_count") >= 5) & ~F.col("is_consolidated")).withColumn("score", score)
    return m.where(F.col("score") >= threshold).withColumn("reason", F.format_string("High access frequency: %d accesses", F.col("access_count")))


def by_retention(memories: DataFrame, as_of: Column, threshold: float) -> DataFrame:
    m = with_strength(memories, as_of).where((F.col("strength") >= threshold) & ~F.col("is_consolidated"))
    return m.withColumn("score", F.col("strength")).withColumn("reason", F.format_string("Strong retention: %.2f", F.col("strength")))


def by_age(memories: DataFrame, as_of: Column, threshold: float) -> DataFrame:
    """Candidates at least 7 whole days old, younger ones scoring higher."""
    days = F.timestamp_diff("DAY", F.col("created_at"), as_of)
    m = memories.withColumn("days", days).where((F.col("days") >= 7) & ~F.col("is_consolidated")).withColumn("score", 1 - F.least(F.col("days") / 30.0, F.lit(1.0)))
    return m.where(F.col("score") >= threshold).withColumn("reason", F.format_string("Age: %d days", F.col("days")))


def consolidate(memories: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Mark the memories in ``ids`` consolidated and strengthen them."""
    m = memories.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return m.withColumn("is_consolidated", F.col("is_consolidated") | hit).withColumn("stability", F.when(hit, F.col("stability") * scalar.RECALL_OK).otherwise(F.col("stability"))).drop("_hit")


def reflect(events: DataFrame, window: str, pattern: str) -> DataFrame:
    """How often each pattern occurs in each window, with its share of the window."""
    g = events.groupBy(F.window("ts", window).alias("w"), pattern).agg(F.count("*").alias("frequency"))
    total = g.groupBy("w").agg(F.sum("frequency").alias("_t"))
    return g.join(total, "w").select(F.col("w.start").alias("start"), pattern, "frequency", (F.col("frequency") / F.col("_t")).alias("importance"))
