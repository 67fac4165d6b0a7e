"""Record logs, constructors, storage columns, trigger parsing and vector primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import bits, scalar
from memlake.operators import crdt, graph, hdc, records
from memlake.plans import graphs, vectors
from memlake.sources import store

PLANS: dict = {}


def plan(name, sql):
    def add(f):
        PLANS[name] = (f, sql)
        return f

    return add


def log(spark, d):
    """Events as the log of one record a user: an error is a deletion."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), "event_type", "value", (F.col("event_type") == "error").alias("deleted"))


@plan("sc_latest", "SELECT user_id AS id, arg_max(event_type, ROW(ts, event_id)) AS event_type, round(arg_max(value, ROW(ts, event_id)), 6) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, ROW(ts, event_id)) <> 'error'")
def _(spark, d):
    return records.latest(log(spark, d), "id", ["ts", "seq"], "deleted").select("id", "event_type", F.round("value", 6).alias("value"))


@plan("sc_versions", "SELECT user_id AS id, count(*) FILTER (event_type <> 'error') AS written, count(*) FILTER (event_type = 'error') AS deletions FROM events GROUP BY user_id")
def _(spark, d):
    return records.versions(log(spark, d), "id", "deleted")


@plan("sc_missing", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(spark, d):
    return records.missing(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id")), log(spark, d).select("id"))


@plan("sc_page", "SELECT doc_id AS id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def _(spark, d):
    return records.paged(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "source"), F.lit(100), 25)


def texts(spark, d):
    """Documents as new text memories, made at an hour of their own."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    source = F.struct(F.col("source").alias("source_id"), F.lit("DirectUserInput").alias("source_type"), (F.lit(0.5) + F.col("doc_id") % 50 / 100).alias("confidence"), F.lit(None).cast("timestamp").alias("timestamp"))
    pad = F.struct(((F.col("doc_id") % 31) / 10 - 1.5).alias("pleasure"), F.lit(0.0).alias("arousal"), F.lit(2.0).alias("dominance"))
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", source.alias("source"), pad.alias("pad"), "doc_id")
    return store.new_text(rows, F.timestamp_add("HOUR", F.col("doc_id") % 1000, F.expr("TIMESTAMP '2024-01-01'")))


_AGE = "(TIMESTAMP '2024-01-01' + to_hours(doc_id % 1000))"


@plan("sc_new_text", "SELECT CAST(doc_id AS VARCHAR) AS id, 'Text' AS modality, length(text) AS n_chars, 0 AS access_count, 0 AS recall_count, false AS is_consolidated, round(0.5 + (doc_id % 50) / 100.0::DOUBLE, 6) AS base_retention, 1.0::DOUBLE AS stability, round(greatest(-1, least(1, (doc_id % 31) / 10.0::DOUBLE - 1.5)), 6) AS pleasure, 1.0::DOUBLE AS dominance, CASE WHEN greatest(-1, least(1, (doc_id % 31) / 10.0::DOUBLE - 1.5::DOUBLE)) > 0.3::DOUBLE THEN 'positive' WHEN greatest(-1, least(1, (doc_id % 31) / 10.0::DOUBLE - 1.5::DOUBLE)) < -0.3::DOUBLE THEN 'negative' ELSE 'neutral' END AS valence FROM documents")
def _(spark, d):
    return texts(spark, d).select("id", "modality", F.length("text").alias("n_chars"), "access_count", "recall_count", "is_consolidated", F.round("base_retention", 6).alias("base_retention"), "stability", F.round("pad.pleasure", 6).alias("pleasure"), "pad.dominance", "valence")


@plan("sc_columnar", f"SELECT CAST(doc_id AS VARCHAR) AS id, epoch_ms({_AGE}) AS created_at, round((0.5 + (doc_id % 50) / 100.0::DOUBLE) * exp(-date_sub('second', {_AGE}, TIMESTAMP '2024-02-15') / 86400.0::DOUBLE), 4) AS strength, 'DirectUserInput' AS source_type, round(0.5 + (doc_id % 50) / 100.0::DOUBLE, 4) AS confidence FROM documents")
def _(spark, d):
    wide = store.columnar(texts(spark, d), F.expr("TIMESTAMP '2024-02-15'"))
    return wide.select("id", "created_at", F.round(F.col("retention_strength").cast("double"), 4).alias("strength"), "source_type", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


@plan("sc_new_intention", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Structured' AS modality, 1.0::DOUBLE AS base_retention, 'Pending' AS status, least(1.0::DOUBLE, o_totalprice / 100000) AS priority FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    trigger = F.struct(F.lit("Immediate").alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("after_s"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("array<string>").alias("contexts"))
    source = F.struct(F.lit("s").alias("source_id"), F.lit("System").alias("source_type"), F.lit(0.9).alias("confidence"), F.lit(None).cast("timestamp").alias("timestamp"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("goal"), trigger.alias("trigger"), (F.col("o_totalprice") / 100000).alias("priority"), source.alias("source"))
    made = store.new_intention(rows, F.expr("TIMESTAMP '2024-01-01'"))
    return made.select("id", "modality", "base_retention", "intention.status", "intention.priority")


@plan("in_parse_trigger", "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'Immediate' WHEN 1 THEN 'TimeBasedAt' WHEN 3 THEN 'TimeBasedAfter' WHEN 4 THEN 'EventBased' WHEN 6 THEN 'ContextBased' END AS kind, CASE WHEN event_id % 7 = 1 THEN TIMESTAMP '2024-01-05 06:00:00' END AS due, CASE WHEN event_id % 7 = 3 THEN event_id END AS after_s, CASE WHEN event_id % 7 = 4 THEN event_type END AS event, CASE WHEN event_id % 7 = 6 THEN event_type || '+here' END AS contexts FROM events")
def _(spark, d):
    """Two of the seven kinds of text do not parse: a bad date and an unknown type."""
    i, none = F.col("event_id"), F.lit(None)
    kinds = ("immediate", "time_based_at", "time_based_at", "time_based_after", "event_based", "unknown", "context_based")
    kind = F.element_at(F.array(*(F.lit(k) for k in kinds)), (i % 7 + 1).cast("int"))
    date = F.when(i % 7 == 1, "2024-01-05T06:00:00Z").when(i % 7 == 2, "soon")
    contexts = F.when(i % 7 == 6, F.array("event_type", F.lit("here")))
    text = F.to_json(F.struct(kind.alias("type"), date.alias("datetime"), F.when(i % 7 == 3, i).otherwise(none).alias("duration_seconds"), F.when(i % 7 == 4, F.col("event_type")).alias("event"), contexts.alias("contexts")))
    t = spark.read.parquet(f"{d}/events.parquet").select(i.alias("id"), store.parse_trigger(text).alias("t"))
    return t.select("id", "t.kind", F.col("t.at").alias("due"), "t.after_s", "t.event", F.when(F.col("t.contexts").isNotNull(), F.array_join("t.contexts", "+")).alias("contexts"))


@plan("em_pad", "WITH v AS (SELECT event_id AS id, greatest(-1, least(1, value / 250 - 1.2::DOUBLE)) AS p, greatest(-1, least(1, (event_id % 9) / 3.0::DOUBLE - 1.3::DOUBLE)) AS a FROM events) SELECT id, round(p, 6) AS pleasure, round(a, 6) AS arousal, round(sqrt(p * p + a * a + 0.25), 6) AS intensity, round(sqrt((p - 0.5) * (p - 0.5) + a * a + 0.0625), 6) AS distance FROM v")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    v = e.select(F.col("event_id").alias("id"), scalar.pad(F.col("value") / 250 - 1.2, F.col("event_id") % 9 / 3 - 1.3, F.lit(0.5)).alias("v"))
    calm = scalar.pad(F.lit(0.5), F.lit(0.0), F.lit(0.25))
    return v.select("id", F.round("v.pleasure", 6).alias("pleasure"), F.round("v.arousal", 6).alias("arousal"), F.round(scalar.intensity(F.col("v")), 6).alias("intensity"), F.round(scalar.pad_distance(F.col("v"), calm), 6).alias("distance"))


@plan("hv_get_set_flip", vectors._BENCH + f" SELECT id, CAST((hv[3] >> 6) & 1 AS INT) AS bit_70, CAST({vectors._sum('hv')} AS INT) AS ones, CAST({vectors._sum('hv')} + 1 - 2 * ((hv[3] >> 6) & 1) AS INT) AS flipped, CAST({vectors._sum('hv')} + 1 - ((hv[3] >> 6) & 1) AS INT) AS with_70, CAST({vectors._sum('hv')} - ((hv[3] >> 6) & 1) AS INT) AS without_70 FROM hv")
def _(spark, d):
    v, ones = F.col("hv"), lambda x, name: bits.count_ones(x).cast("int").alias(name)
    return vectors.encoded(spark, d).select("id", bits.get_bit(v, F.lit(70)).cast("int").alias("bit_70"), ones(v, "ones"), ones(bits.flip_bit(v, 70), "flipped"), ones(bits.set_bit(v, 70, True), "with_70"), ones(bits.set_bit(v, 70, False), "without_70"))


@plan("hv_bind_multiple", vectors._BENCH + ", x AS (SELECT id % 5 AS g, i, bit_xor(hv[i]) AS w FROM hv CROSS JOIN (SELECT unnest(range(1, 9)) AS i) GROUP BY ALL) SELECT g, array_to_string(list(w ORDER BY i), ',') AS words FROM x GROUP BY g")
def _(spark, d):
    bound = hdc.bind_all(vectors.encoded(spark, d).withColumn("g", F.col("id") % 5), ["g"], "hv")
    return bound.select("g", F.array_join(F.col("hv").cast("array<string>"), ",").alias("words"))


@plan("hv_topk", vectors._BENCH + f", q AS (SELECT {hdc.encode_text(vectors.QUERY, vectors.DIM)}::BIGINT[] AS q) SELECT id, CAST({vectors._ham('hv', 'q')} AS INT) AS distance, round(1 - {vectors._ham('hv', 'q')} / 256.0::DOUBLE, 6) AS similarity FROM hv, q ORDER BY distance, id LIMIT 12")
def _(spark, d):
    top = hdc.most_similar(vectors.encoded(spark, d), hdc.encode_text(vectors.QUERY, vectors.DIM), vectors.DIM, 12, "id", "hv")
    return top.select("id", F.col("distance").cast("int").alias("distance"), F.round("similarity", 6).alias("similarity"))


@plan("gr_neighbors_list", graphs._hops(2, "relationship IN ('region', 'customer')"))
def _(spark, d):
    return graph.neighbors(graphs.tables(spark, d)[1], "r1", 2, ["region", "customer"])


@plan("cr_clock_get", "SELECT user_id AS id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'none') AS absent FROM events GROUP BY user_id")
def _(spark, d):
    """A node without events stands at 0."""
    clock = crdt.clocks(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "event_type")
    return clock.select(F.col("user_id").alias("id"), scalar.clock_get(F.col("clock"), "view").cast("long").alias("views"), scalar.clock_get(F.col("clock"), "none").cast("long").alias("absent"))
