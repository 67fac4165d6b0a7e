"""Retention, affect, intention, consolidation and statistics over events and orders."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from memlake.functions import scalar
from memlake.operators import memory

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
PLANS: dict = {}


def T():
    return F.expr(AS_OF)

# The events table as memories, the same columns in both engines.
_COLUMNS = (
    "event_id AS id", "ts AS created_at", "ts AS last_recall", "0.5D + (event_id % 50) / 100D AS base_retention", "CAST(1 + user_id % 7 AS DOUBLE) AS stability", "CAST(event_id % 11 AS INT) AS recall_count",
    "CAST(event_id % 14 AS INT) AS access_count", "event_id % 9 = 0 AS is_consolidated", "event_type AS source_type", "user_id", "event_type", "event_id",
    "greatest(-1D, least(1D, (value % 20D) / 10D - 1D)) AS p", "greatest(-1D, least(1D, (event_id % 21) / 10D - 1D)) AS a", "greatest(-1D, least(1D, (user_id % 21) / 10D - 1D)) AS d", "ts", f"{AS_OF} AS as_of",
)
_DUCK = "WITH m AS (SELECT " + re.sub(r"(\d)D\b", r"\1::DOUBLE", ", ".join(_COLUMNS)) + " FROM events), s AS (SELECT *, base_retention * exp(-date_sub('second', last_recall, as_of) / (greatest(stability, 0.1) * 86400)) AS st, CASE WHEN p > 0.3::DOUBLE THEN 'positive' WHEN p < -0.3::DOUBLE THEN 'negative' ELSE 'neutral' END AS valence, sqrt(p * p + a * a + d * d) AS intensity FROM m) "


def events(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_COLUMNS)
    return m.withColumn("pad", F.struct(F.col("p").alias("pleasure"), F.col("a").alias("arousal"), F.col("d").alias("dominance"))).withColumn("valence", scalar.valence(F.col("p")))


def plan(name, sql):
    def add(f):
        PLANS[name] = (f, sql and (_DUCK + sql if sql.startswith("SELECT") else sql))
        return f

    return add




@plan("rt_strength", "SELECT id, round(st, 6) AS strength FROM s")
def _(spark, d):
    return memory.with_strength(events(spark, d), T()).select("id", F.round("strength", 6).alias("strength"))


@plan("rt_forget", "SELECT id FROM s WHERE st < 0.3::DOUBLE")
def _(spark, d):
    return memory.weak(events(spark, d), T(), 0.3).select("id")


@plan("rt_survivors", "SELECT count(*) AS n FROM s WHERE st >= 0.3::DOUBLE")
def _(spark, d):
    return memory.survivors(events(spark, d), T(), 0.3).agg(F.count("*").alias("n"))


@plan("rt_active_topk", "SELECT id, recall_count FROM s WHERE st > 0.3::DOUBLE ORDER BY recall_count DESC, id LIMIT 20")
def _(spark, d):
    return memory.active_top(events(spark, d), T(), 0.3, 20).select("id", "recall_count")


_PREDICT = "CASE WHEN {t} < base_retention AND CAST(trunc(-stability * 86400 * ln({t} / base_retention)) AS BIGINT) > 0 THEN last_recall + to_seconds(CAST(trunc(-stability * 86400 * ln({t} / base_retention)) AS BIGINT)) END"


@plan("rt_predict", "SELECT id, " + _PREDICT.format(t="0.4::DOUBLE") + " AS forget_at FROM s")
def _(spark, d):
    return events(spark, d).select("id", scalar.forget_time(F.col("base_retention"), F.col("last_recall"), F.col("stability"), F.lit(0.4)).alias("forget_at"))


@plan("rt_reviews", "SELECT id, " + _PREDICT.format(t="0.7::DOUBLE") + " AS forget_at FROM s WHERE " + _PREDICT.format(t="0.7::DOUBLE") + " IS NOT NULL")
def _(spark, d):
    return memory.reviews(events(spark, d), 0.7).select("id", "forget_at")




_FOLD = "SELECT user_id, count(*) FILTER (event_type <> 'error') AS recall_count, count(*) AS access_count, round(ln(pow(1.5::DOUBLE, count(*) FILTER (event_type <> 'error')) * pow(0.9::DOUBLE, count(*) FILTER (event_type = 'error'))), 6) AS ln_stability, round(CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN least(1.0::DOUBLE, 0.5 * pow(1.05::DOUBLE, count(*) FILTER (event_type <> 'error'))) ELSE 0.5::DOUBLE END, 6) AS base_retention, max(ts) AS last_recall FROM events GROUP BY user_id"


@plan("rt_recall_fold", _FOLD)
def _(spark, d):
    """All recalls of each user; stability is reported as its logarithm, since hundreds of recalls pass the range of rounding."""
    e = spark.read.parquet(f"{d}/events.parquet")
    ok = F.col("event_type") != "error"
    f = memory.fold_recalls(e, "user_id", F.lit(0.5), ok, ~ok)
    return f.select("user_id", "recall_count", "access_count", F.round(F.ln("stability"), 6).alias("ln_stability"), F.round("base_retention", 6).alias("base_retention"), "last_recall")


@plan("rt_forget_criteria", "SELECT id FROM s WHERE st < 0.4::DOUBLE AND created_at < TIMESTAMP '2024-01-10 00:00:00' AND source_type = 'view'")
def _(spark, d):
    return memory.forget(events(spark, d), T(), 0.4, F.expr("TIMESTAMP '2024-01-10 00:00:00'"), "view").select("id")


@plan("em_valence", "SELECT id, valence, round(intensity, 6) AS intensity FROM s")
def _(spark, d):
    return events(spark, d).select("id", "valence", F.round(scalar.intensity(F.col("pad")), 6).alias("intensity"))


@plan("em_stats", "SELECT count(*) FILTER (valence = 'positive') AS n_positive, count(*) FILTER (valence = 'negative') AS n_negative, count(*) FILTER (valence = 'neutral') AS n_neutral, round(avg(intensity), 6) AS avg_intensity FROM s")
def _(spark, d):
    return memory.emotion_stats(events(spark, d)).withColumn("avg_intensity", F.round("avg_intensity", 6))


@plan("em_search", "SELECT id, round(st, 6) AS strength FROM s WHERE valence = 'positive' ORDER BY st DESC, id LIMIT 25")
def _(spark, d):
    return memory.search_emotion(events(spark, d), T(), "positive", 25).select("id", F.round("strength", 6).alias("strength"))


@plan("em_similar", "SELECT id, round(sqrt((p-0.8)*(p-0.8)+(a-0.4)*(a-0.4)+(d-0.2)*(d-0.2)), 6) AS distance FROM s WHERE sqrt((p-0.8)*(p-0.8)+(a-0.4)*(a-0.4)+(d-0.2)*(d-0.2)) <= 0.5 ORDER BY sqrt((p-0.8)*(p-0.8)+(a-0.4)*(a-0.4)+(d-0.2)*(d-0.2)), id LIMIT 30")
def _(spark, d):
    return memory.search_affect(events(spark, d), scalar.pad(F.lit(0.8), F.lit(0.4), F.lit(0.2)), 30, 0.5).select("id", F.round("distance", 6).alias("distance"))


@plan("em_history", "SELECT user_id, count(*) AS n_moods, round(arg_max(p, ROW(ts, id)), 6) AS pleasure, arg_max(valence, ROW(ts, id)) AS valence FROM s GROUP BY user_id")
def _(spark, d):
    f = memory.fold_emotions(events(spark, d).withColumn("seq", F.col("id")), "user_id")
    return f.select("user_id", "n_moods", F.round("pad.pleasure", 6).alias("pleasure"), "valence")


@plan("em_mood_log", "SELECT user_id, len(list(p)) AS n, round(list_sum(list(p ORDER BY ts, id)[1:5]), 6) AS first_five FROM s GROUP BY user_id")
def _(spark, d):
    h = memory.mood_history(events(spark, d).withColumn("seq", F.col("id")), "user_id")
    first = F.aggregate(F.slice("mood_history", 1, 5), F.lit(0.0), lambda s, x: s + x["pad"]["pleasure"])
    return h.select("user_id", F.size("mood_history").cast("long").alias("n"), F.round(first, 6).alias("first_five"))


@plan("em_update", "SELECT id, CASE WHEN p * 0.5 > 0.3 THEN 'positive' WHEN p * 0.5 < -0.3 THEN 'negative' ELSE 'neutral' END AS valence FROM s")
def _(spark, d):
    moods = events(spark, d).select("id", F.expr("stack(2, 1, p, 2, p * 0.5)").alias("seq", "pleasure"), "a", "d", "ts")
    return memory.fold_emotions(moods.withColumn("pad", scalar.pad(F.col("pleasure"), F.col("a"), F.col("d"))), "id").select("id", "valence")


_ORDERS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Active' ELSE 'Completed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'Immediate' ELSE 'TimeBasedAt' END AS kind, o_orderdate AS due, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), o_totalprice / 400000)) AS priority FROM orders"


def intentions(spark, d):
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("memlake_orders")
    return spark.sql(_ORDERS.replace("FROM orders", "FROM memlake_orders")).withColumnRenamed("due", "at")


def _in(name, sql):
    return plan(name, f"WITH i AS ({_ORDERS}) {sql}")


@_in("in_active", "SELECT id, priority FROM i WHERE status IN ('Pending', 'Active')")
def _(spark, d):
    return memory.active_intentions(intentions(spark, d)).select("id", "priority")


@_in("in_triggerable", "SELECT id, kind FROM i WHERE status IN ('Pending', 'Active') AND (kind = 'Immediate' OR due <= TIMESTAMP '1998-01-01 00:00:00')")
def _(spark, d):
    return memory.triggerable(intentions(spark, d), F.expr("TIMESTAMP '1998-01-01 00:00:00'")).select("id", "kind")


@_in("in_complete", "SELECT id, CASE WHEN id % 7 = 0 THEN 'Cancelled' WHEN id % 5 = 0 THEN 'Completed' ELSE status END AS status FROM i")
def _(spark, d):
    i = intentions(spark, d)
    log = i.select("id", F.lit(1).alias("seq"), "status").union(i.where("id % 5 = 0").select("id", F.lit(2), F.lit("Completed"))).union(i.where("id % 7 = 0").select("id", F.lit(3), F.lit("Cancelled")))
    return memory.fold_statuses(log.withColumn("ts", T()), "id").select("id", "status")


@plan("co_access", "SELECT id, least(access_count, 10) / 10.0::DOUBLE AS score, 'High access frequency: ' || access_count || ' accesses' AS reason FROM s WHERE access_count >= 5 AND NOT is_consolidated AND least(access_count, 10) / 10.0::DOUBLE >= 0.6")
def _(spark, d):
    return memory.by_access(events(spark, d), 0.6).select("id", F.col("score").cast("double").alias("score"), "reason")


@plan("co_retention", "SELECT id, round(st, 6) AS score FROM s WHERE st >= 0.5::DOUBLE AND NOT is_consolidated")
def _(spark, d):
    return memory.by_retention(events(spark, d), T(), 0.5).select("id", F.round("score", 6).alias("score"))


@plan("co_temporal", "SELECT id, round(1 - least(date_sub('day', created_at, as_of) / 30.0::DOUBLE, 1.0::DOUBLE), 6) AS score, 'Age: ' || date_sub('day', created_at, as_of) || ' days' AS reason FROM s WHERE date_sub('day', created_at, as_of) >= 7 AND NOT is_consolidated AND 1 - least(date_sub('day', created_at, as_of) / 30.0::DOUBLE, 1.0::DOUBLE) >= 0.45")
def _(spark, d):
    return memory.by_age(events(spark, d), T(), 0.45).select("id", F.round("score", 6).alias("score"), "reason")


@plan("co_consolidate", "SELECT id, is_consolidated OR access_count >= 12 AS is_consolidated, CASE WHEN access_count >= 12 THEN stability * 1.5 ELSE stability END AS stability FROM s")
def _(spark, d):
    e = events(spark, d)
    return memory.consolidate(e, e.where("access_count >= 12")).select("id", "is_consolidated", "stability")


@plan("ext_reflect", "WITH g AS (SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS frequency FROM events GROUP BY ALL) SELECT start, event_type, frequency, round(frequency / sum(frequency) OVER (PARTITION BY start), 6) AS importance FROM g")
def _(spark, d):
    return memory.reflect(spark.read.parquet(f"{d}/events.parquet"), "7 days", "event_type").withColumn("importance", F.round("importance", 6))


@plan("mg_stats", "WITH e AS (SELECT event_id, ts, event_type, CAST(floor(value) AS BIGINT) AS n FROM events) SELECT count(*) FILTER (event_type = 'signup') AS total_memories, count(*) FILTER (event_type = 'view') AS total_searches, CAST(coalesce(sum(n) FILTER (event_type = 'error'), 0) AS BIGINT) AS total_forgotten, coalesce(arg_max(n, ROW(ts, event_id)) FILTER (event_type = 'error'), 0) AS last_forgotten, count(*) FILTER (event_type = 'purchase') AS consolidations, count(*) FILTER (event_type = 'click') AS recalls FROM e")
def _(spark, d):
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "add", "view", "search", "error", "forget", "purchase", "consolidate", "click", "recall_ok")]), F.col("event_type"))
    e = spark.read.parquet(f"{d}/events.parquet").select(op.alias("op"), "ts", F.col("event_id").alias("seq"), F.floor("value").alias("n"))
    return memory.stats(e).select("total_memories", "total_searches", "total_forgotten", "last_forgotten", "consolidations", "recalls")


@plan("pr_memory_response", "SELECT id, event_type AS text, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, access_count, round(st, 6) AS retention_strength, valence, id % 4 = 0 AS is_prospective FROM s")
def _(spark, d):
    e = events(spark, d).withColumn("text", F.col("event_type")).withColumn("goal", F.when(F.col("id") % 4 == 0, "go"))
    return memory.response(e, T()).withColumn("retention_strength", F.round("retention_strength", 6))
