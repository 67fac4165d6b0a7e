"""CRDT, conflict and trust queries over events, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.functions import scalar
from memlake.operators import conflict, crdt

PLANS: dict = {}


def E():
    return F.col("e")


def N():
    return F.col("n")


def plan(name, sql=None):
    def add(f):
        PLANS[name] = (f, sql)
        return f

    return add


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


# Clocks: how many events of each type a user has in a half month.
_NODES = "SELECT user_id, CAST(day(ts) > 15 AS INT) AS half, event_type, count(*) AS n FROM events GROUP BY ALL"


def clocks(spark, d):
    c = crdt.clocks(events(spark, d).withColumn("half", (F.dayofmonth("ts") > 15).cast("int")), ["user_id", "half"], "event_type")
    return c.where("half = 0").select("user_id", F.col("clock").alias("a")).join(c.where("half = 1").select("user_id", F.col("clock").alias("b")), "user_id")


_PAIRED = f"WITH c AS ({_NODES}), u AS (SELECT user_id FROM c GROUP BY user_id HAVING count(DISTINCT half) = 2), p AS (SELECT user_id, event_type, coalesce(max(n) FILTER (half = 0), 0) AS a, coalesce(max(n) FILTER (half = 1), 0) AS b FROM c JOIN u USING (user_id) GROUP BY ALL)"
_ORDER = "CASE WHEN bool_or(a > b) AND bool_or(a < b) THEN 'concurrent' WHEN bool_or(a > b) THEN 'greater' WHEN bool_or(a < b) THEN 'less' ELSE 'equal' END"


@plan("cr_clock_cmp", _PAIRED + f" SELECT user_id, {_ORDER} AS ordering FROM p GROUP BY user_id")
def _(spark, d):
    return clocks(spark, d).select("user_id", scalar.clock_order(F.col("a"), F.col("b")).alias("ordering"))


@plan("cr_clock_merge", _PAIRED + " SELECT user_id, string_agg(event_type || '=' || greatest(a, b), ',' ORDER BY event_type) AS merged FROM p GROUP BY user_id")
def _(spark, d):
    m = scalar.clock_merge(F.col("a"), F.col("b"))
    return clocks(spark, d).select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("merged"))


@plan("cr_clock_merge_n", f"WITH c AS ({_NODES}) SELECT event_type AS node, max(n) AS n FROM c GROUP BY event_type")
def _(spark, d):
    c = crdt.clocks(events(spark, d).withColumn("half", (F.dayofmonth("ts") > 15).cast("int")), ["user_id", "half"], "event_type")
    return crdt.merge_clocks(c.withColumn("all", F.lit(1)), ["all"]).select(F.explode("clock").alias("node", "n"))


@plan("cr_lww", "WITH o AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS elem, event_type = 'error' AS gone, ts FROM events), g AS (SELECT user_id, elem, max(ts) FILTER (NOT gone) AS a, max(ts) FILTER (gone) AS r FROM o GROUP BY ALL) SELECT user_id, elem FROM g WHERE a IS NOT NULL AND (r IS NULL OR a > r)")
def _(spark, d):
    o = events(spark, d).select("user_id", F.get_json_object("props", "$.k").cast("long").alias("elem"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"), "ts")
    return crdt.lww(o, ["user_id", "elem"]).select("user_id", "elem")


@plan("cr_lww_merge", PLANS["cr_lww"][1])
def _(spark, d):
    """Two replicas (odd and even events) merged: the union of their logs."""
    o = events(spark, d).select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("elem"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"), "ts")
    return crdt.lww(o.where("event_id % 2 = 0").unionByName(o.where("event_id % 2 = 1")), ["user_id", "elem"]).select("user_id", "elem")


@plan("cr_merge", _PAIRED + f" SELECT user_id, CASE {_ORDER} WHEN 'greater' THEN 'a' WHEN 'less' THEN 'b' ELSE CASE WHEN sum(a) % 3 > sum(b) % 3 THEN 'a' ELSE 'b' END END AS winner FROM p GROUP BY user_id")
def _(spark, d):
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, v: s + v) % 3
    wins = crdt.merged_wins(F.col("a"), total(F.col("a")), F.lit("a"), F.col("b"), total(F.col("b")), F.lit("b"))
    return clocks(spark, d).select("user_id", F.when(wins, "a").otherwise("b").alias("winner"))




@plan("cr_supersedes", _PAIRED + f" SELECT user_id, user_id % 10 = 0 OR {_ORDER} = 'greater' AS supersedes FROM p GROUP BY user_id")
def _(spark, d):
    c = clocks(spark, d).withColumn("s", F.when(F.col("user_id") % 10 == 0, "b"))
    return c.select("user_id", crdt.supersedes(F.col("a"), F.col("s"), F.col("b"), F.lit("b")).alias("supersedes"))


# Facts: each event states something about its user; a pair is an event and the user's next one.
_FACT = """CAST(user_id AS VARCHAR) AS subject, event_type AS predicate, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 < 4 THEN 'true' ELSE 'false' END WHEN 1 THEN CASE WHEN event_id % 8 < 4 THEN '"x"' ELSE '"not_x"' END
 WHEN 2 THEN CASE WHEN event_id % 8 < 4 THEN '{"a":1,"b":2}' ELSE '{"b":3,"c":4}' END ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS object"""
_PAIRS = f"""WITH f AS (SELECT event_id AS id, ts, user_id, {_FACT}, 0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE AS confidence, event_id % 8 >= 4 AS odd, event_id % 4 AS form, event_id % 6 = 0 AS bare, user_id % 5 AS s1, event_id % 3 AS s2 FROM events),
 p AS (SELECT id, lead(id) OVER w AS nid, subject AS es, predicate AS ep, object AS eo, ts AS et, confidence AS ec, form AS ef, odd AS eodd, bare AS eb, s1 AS e1, s2 AS e2, lead(predicate) OVER w AS np, lead(object) OVER w AS no, lead(ts) OVER w AS nt, lead(confidence) OVER w AS nc, lead(form) OVER w AS nf, lead(odd) OVER w AS nodd, lead(bare) OVER w AS nb, lead(s1) OVER w AS n1, lead(s2) OVER w AS n2 FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
 q AS (SELECT *, ep = np AS same, ef = nf AND ef IN (0, 1) AND eodd <> nodd AS contra, ef = 2 AND nf = 2 AND eodd <> nodd AS part, eb <> nb OR (NOT eb AND e2 <> n2) AS srcdiff FROM p WHERE nid IS NOT NULL),
 c AS (SELECT *, CASE WHEN same AND contra THEN 'ContradictoryFacts' WHEN same AND et < nt THEN 'TemporalSupersession' WHEN same AND part THEN 'PartialOverlap' WHEN same THEN 'AttributeUpdate' WHEN srcdiff THEN 'SourceDisagreement' ELSE 'ReferenceAmbiguity' END AS kind FROM q) """


def facts(spark, d):
    e = events(spark, d).selectExpr("event_id AS id", "ts", "user_id", _FACT.split(", CASE")[0].split(" AS subject")[0].replace("VARCHAR", "STRING") + " AS subject", "event_type AS predicate", "CASE" + _FACT.split(", CASE", 1)[1].replace("VARCHAR", "STRING"), "0.5D + (event_id % 50) / 100D AS confidence", "event_id % 6 = 0 AS bare", "user_id % 5 AS s1", "event_id % 3 AS s2")
    sources = F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("u"), F.col("s1")), F.concat(F.lit("e"), F.col("s2"))))
    return e.withColumn("f", F.struct("id", "subject", "predicate", "object", F.col("ts").alias("created_at"), "confidence", sources.alias("sources")))


def pairs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    p = facts(spark, d).select("id", "user_id", F.col("f").alias("e"), F.lead("f").over(w).alias("n")).where("n is not null")
    return p.withColumn("conflict_type", conflict.conflict_type(F.col("e"), F.col("n")))




def trust(spark):
    return spark.createDataFrame([(f"{k}{i}", 0.15 * (i + 1) + (0.1 if k == "u" else 0.0)) for k, m in (("u", 4), ("e", 2)) for i in range(m)], "source_id string, value double")


def _t(k, col, m, add):
    return f"CASE WHEN {col} < {m} THEN 0.15::DOUBLE * ({col} + 1) + {add} ELSE 0.5::DOUBLE END"


def _side(x):
    return f"CASE WHEN {x}b THEN 0.5::DOUBLE ELSE ({_t('u', x + '1', 4, '0.1::DOUBLE')} + {_t('e', x + '2', 2, '0')}) / 2 END", f"CASE WHEN {x}b THEN 0.0::DOUBLE ELSE {_t('u', x + '1', 4, '0.1::DOUBLE')} + {_t('e', x + '2', 2, '0')} END"


(_ET, _EV), (_NT, _NV) = _side("e"), _side("n")


def result(df, expr):
    return df.select("id", expr.alias("r")).select("id", "r.winner", F.round("r.confidence", 6).alias("confidence"), "r.needs_review")


def _sql(winner, confidence, review):
    return _PAIRS + f"SELECT id, {winner} AS winner, round({confidence}, 6) AS confidence, {review} AS needs_review FROM c"


@plan("cf_detect", _PAIRS + "SELECT id, kind AS conflict_type FROM c")
def _(spark, d):
    return pairs(spark, d).select("id", "conflict_type")


@plan("cf_detect_strict", _PAIRS + "SELECT id, CASE WHEN same AND eo = no THEN 'DuplicateInformation' ELSE kind END AS conflict_type FROM c")
def _(spark, d):
    return pairs(spark, d).select("id", conflict.conflict_type(E(), N(), strict=True).alias("conflict_type"))


@plan("cf_bench_detectors", _PAIRS + "SELECT id, same AND et <> nt AS temporal, same AND eo <> no AS contradiction FROM c")
def _(spark, d):
    same = (E()["subject"] == N()["subject"]) & (E()["predicate"] == N()["predicate"])
    return pairs(spark, d).select("id", (same & (E()["created_at"] != N()["created_at"])).alias("temporal"), (same & (E()["object"] != N()["object"])).alias("contradiction"))


_STRATEGY = "CASE WHEN kind = 'SourceDisagreement' THEN 'KeepOldest' WHEN CAST(es AS BIGINT) % 9 = 0 THEN 'DomainSpecificRules' ELSE CASE kind WHEN 'TemporalSupersession' THEN 'KeepNewest' WHEN 'AttributeUpdate' THEN 'MergeViaCRDT' WHEN 'ContradictoryFacts' THEN 'TrustHigherSource' WHEN 'PartialOverlap' THEN 'MergeViaCRDT' WHEN 'SourceDisagreement' THEN 'ConsensusVoting' ELSE 'DeferToUser' END END"


def with_strategy(spark, d, precedents=True):
    rows = [("SourceDisagreement", "KeepOldest", True, 0.9), ("SourceDisagreement", "VersionBranching", True, 0.85), ("ContradictoryFacts", "KeepNewest", False, 0.99), ("TemporalSupersession", "KeepOldest", True, 0.8)]
    p = spark.createDataFrame(rows if precedents else [], "conflict_type string, strategy string, success boolean, relevance double")
    df = pairs(spark, d).withColumn("domain", F.when(F.col("user_id") % 9 == 0, "d9"))
    return conflict.strategies(df, p, ["d9"])


@plan("cf_strategy", _PAIRS + f"SELECT id, {_STRATEGY} AS strategy FROM c")
def _(spark, d):
    return with_strategy(spark, d).select("id", "strategy")


@plan("cf_newest", _sql("CASE WHEN et < nt THEN 'new' ELSE 'existing' END", "0.95::DOUBLE", "false"))
def _(spark, d):
    return result(pairs(spark, d), conflict.keep_newest(E(), N()))


@plan("cf_oldest", _sql("CASE WHEN et < nt THEN 'existing' ELSE 'new' END", "0.9::DOUBLE", "false"))
def _(spark, d):
    return result(pairs(spark, d), conflict.keep_oldest(E(), N()))


@plan("cf_merge", _sql("CASE WHEN ec > nc THEN 'existing' ELSE 'new' END", "0.85::DOUBLE", "false"))
def _(spark, d):
    return result(pairs(spark, d), conflict.merge_crdt(E()["confidence"] > N()["confidence"]))


@plan("cf_trust", _sql(f"CASE WHEN round(({_ET}) * ec, 9) > round(({_NT}) * nc, 9) THEN 'existing' ELSE 'new' END", f"greatest(({_ET}) * ec, ({_NT}) * nc)", f"round(greatest(({_ET}) * ec, ({_NT}) * nc), 9) < 0.7"))
def _(spark, d):
    p = conflict.with_source_trust(pairs(spark, d), trust(spark))
    return result(p, conflict.trust_higher(F.round("e_trust", 9), F.round("n_trust", 9)))


@plan("cf_consensus", _PAIRS.rstrip() + f", v AS (SELECT id, same AND eo = no AS dup, round({_EV}, 9) AS a, round({_NV}, 9) AS b FROM c) SELECT id, CASE WHEN dup OR a + b = 0 THEN 'existing' WHEN b > a THEN 'new' ELSE 'existing' END AS winner, round(CASE WHEN a + b = 0 THEN NULL WHEN dup THEN 1 ELSE greatest(a, b) / (a + b) END, 6) AS confidence, a + b = 0 AS needs_review FROM v")
def _(spark, d):
    p = conflict.with_source_trust(pairs(spark, d), trust(spark))
    return result(p, conflict.consensus(E(), N(), F.round("e_votes", 9), F.round("n_votes", 9)))


@plan("cf_logic", _PAIRS.rstrip() + ", o AS (SELECT object AS k, count(*) AS n FROM f GROUP BY 1), s AS (SELECT subject AS k, count(*) AS n FROM f GROUP BY 1), v AS (SELECT c.id, contra, coalesce(o1.n, 0) + coalesce(s1.n, 0) AS a, coalesce(o2.n, 0) + coalesce(s2.n, 0) AS b FROM c LEFT JOIN o o1 ON o1.k = es LEFT JOIN s s1 ON s1.k = eo LEFT JOIN o o2 ON o2.k = es LEFT JOIN s s2 ON s2.k = no) SELECT id, CASE WHEN NOT contra THEN 'both' WHEN b > a THEN 'new' ELSE 'existing' END AS winner, CASE WHEN contra THEN 0.75::DOUBLE ELSE 0.8::DOUBLE END AS confidence, contra AS needs_review FROM v")
def _(spark, d):
    related = facts(spark, d).select("subject", "object")
    return result(conflict.with_support(pairs(spark, d), related), conflict.logic_rules(E(), N(), F.col("e_support"), F.col("n_support")))


@plan("cf_branch", _PAIRS + "SELECT id, unnest(['existing', 'new']) AS side, round(unnest([ec, nc]) * 0.8, 6) AS confidence FROM c")
def _(spark, d):
    each = F.explode(F.array(F.struct(F.lit("existing").alias("side"), E()["confidence"].alias("c")), F.struct(F.lit("new").alias("side"), N()["confidence"].alias("c"))))
    return pairs(spark, d).select("id", each.alias("x")).select("id", "x.side", F.round(F.col("x.c") * 0.8, 6).alias("confidence"))


@plan("cf_domain", _PAIRS + "SELECT id, CASE WHEN part THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS confidence, nf = 2 AND nodd AS renewed FROM c")
def _(spark, d):
    r = conflict.domain_rules(E(), N(), ["c"], ["b"])
    return pairs(spark, d).select("id", r["confidence"].alias("confidence"), conflict.domain_renewed(N(), ["c"]).alias("renewed"))


def resolved(spark, d):
    p = conflict.with_support(conflict.with_source_trust(with_strategy(spark, d), trust(spark)), facts(spark, d).select("subject", "object"))
    return conflict.resolve(p, E()["confidence"] > N()["confidence"], ["c"], ["b"])


_RESOLVED = _PAIRS.rstrip() + f", g AS (SELECT id, kind, {_STRATEGY} AS strategy, greatest(({_ET}) * ec, ({_NT}) * nc) AS tc, part FROM c), r AS (SELECT *, CASE strategy WHEN 'KeepNewest' THEN 0.95::DOUBLE WHEN 'KeepOldest' THEN 0.9::DOUBLE WHEN 'MergeViaCRDT' THEN 0.85::DOUBLE WHEN 'TrustHigherSource' THEN tc WHEN 'DomainSpecificRules' THEN CASE WHEN part THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END END AS conf, strategy = 'TrustHigherSource' AND tc < 0.7::DOUBLE AS review FROM g) "


def _stats(key):
    return _RESOLVED + f"SELECT {key}, count(*) AS n, round(avg(conf), 6) AS avg_confidence, count(*) FILTER (review) AS n_review, count(*) FILTER (strategy IN ('ConsensusVoting', 'DomainSpecificRules')) AS n_external FROM r WHERE conf IS NOT NULL GROUP BY 1"


@plan("cf_stats", _stats("kind AS conflict_type"))
def _(spark, d):
    return conflict.resolution_stats(resolved(spark, d), "conflict_type").withColumn("avg_confidence", F.round("avg_confidence", 6))


@plan("cf_stats_strategy", _stats("strategy"))
def _(spark, d):
    return conflict.resolution_stats(resolved(spark, d), "strategy").withColumn("avg_confidence", F.round("avg_confidence", 6))


@plan("cf_success_rate", _RESOLVED + "SELECT round(avg(CAST(conf > 0.7 AND NOT review AS INT)), 6) AS success_rate FROM r WHERE conf IS NOT NULL")
def _(spark, d):
    return conflict.success_rate(resolved(spark, d)).withColumn("success_rate", F.round("success_rate", 6))


@plan("cr_merge_facts", "WITH k AS (SELECT event_id AS id, user_id, event_type, event_id % 4 AS a, event_id % 5 AS b, event_id % 3 AS lam FROM events), z AS (SELECT * FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.user_id = x.user_id AND y.event_type = x.event_type AND y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))) SELECT user_id, event_type, arg_max(id, ROW(lam, lpad(CAST(id AS VARCHAR), 12, '0'))) AS id FROM z GROUP BY ALL")
def _(spark, d):
    f = events(spark, d).select("user_id", "event_type", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.create_map(F.lit("a"), F.col("event_id") % 4, F.lit("b"), F.col("event_id") % 5).alias("clock"), (F.col("event_id") % 3).alias("lamport"))
    return crdt.merge_facts(f, ["user_id", "event_type"]).select("user_id", "event_type", F.col("id").cast("long").alias("id"))


def feedback(spark, d):
    l, docs = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("labels", "documents"))  # noqa: E741
    j = l.join(docs.select("doc_id", "source"), "doc_id")
    return j.select(F.col("source").alias("source_id"), F.col("doc_id").alias("seq"), F.when(F.col("toxic") == 1, "conflict").when(F.col("doc_id") % 50 == 0, "category").otherwise("update").alias("kind"), (F.col("quality") == 1).alias("success"), (F.lit(0.5) + (F.col("doc_id") % 50) / 100).alias("confidence"), F.lit("External").alias("category"))


_FEED = "f AS (SELECT source, doc_id, quality = 1 AS ok, CASE WHEN toxic = 1 THEN 'conflict' WHEN doc_id % 50 = 0 THEN 'category' ELSE 'update' END AS kind, 0.5::DOUBLE + (doc_id % 50) / 100.0::DOUBLE AS conf, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM labels JOIN documents USING (doc_id))"
_FOLD = f"""WITH RECURSIVE {_FEED}, t AS (SELECT source, CAST(0 AS BIGINT) AS r, 0.5::DOUBLE AS v, 0 AS ok, 0 AS bad, 0 AS con, 0.0::DOUBLE AS avg, false AS known FROM (SELECT DISTINCT source FROM f) UNION ALL
 SELECT t.source, f.r, CASE f.kind WHEN 'update' THEN greatest(0.1::DOUBLE, least(0.95::DOUBLE, 0.5::DOUBLE + (t.v * 0.9::DOUBLE + (t.ok + f.ok::INT) / (t.ok + t.bad + 1)::DOUBLE * f.conf * 0.1::DOUBLE - 0.5::DOUBLE))) WHEN 'conflict' THEN CASE WHEN t.known THEN greatest(0.1::DOUBLE, t.v - 0.02::DOUBLE) ELSE t.v END ELSE 0.5::DOUBLE END,
 t.ok + CASE WHEN f.kind = 'update' THEN f.ok::INT ELSE 0 END, t.bad + CASE WHEN f.kind = 'update' THEN (NOT f.ok)::INT ELSE 0 END, t.con + (f.kind = 'conflict')::INT, CASE WHEN f.kind = 'update' THEN (t.avg * (t.ok + t.bad) + f.conf) / (t.ok + t.bad + 1)::DOUBLE ELSE t.avg END, t.known OR f.kind <> 'conflict' FROM t JOIN f ON f.source = t.source AND f.r = t.r + 1), z AS (SELECT source, arg_max(v, r) AS v, arg_max(ok, r) AS ok, arg_max(bad, r) AS bad, arg_max(con, r) AS con, arg_max(avg, r) AS avg FROM t GROUP BY source) """


@plan("tr_update_fold", _FOLD + "SELECT source AS source_id, round(v, 6) AS value, ok AS successes, bad AS failures, con AS conflicts, round(avg, 6) AS avg_confidence FROM z")
def _(spark, d):
    return conflict.fold_trust(feedback(spark, d)).withColumn("value", F.round("value", 6)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@plan("tr_rank", _FOLD + "SELECT source AS source_id, CAST(row_number() OVER (ORDER BY round(v, 6) DESC, source) AS INT) AS rank FROM z")
def _(spark, d):
    """One row a source: the window is over the folded scores."""
    f = conflict.fold_trust(feedback(spark, d))
    return f.select("source_id", F.row_number().over(Window.orderBy(F.round("value", 6).desc(), "source_id")).alias("rank"))


@plan("tr_conflict", f"WITH {_FEED} SELECT source AS source_id, count(*) FILTER (kind = 'conflict') AS conflicts, count(*) FILTER (kind <> 'conflict') AS rest FROM f GROUP BY source")
def _(spark, d):
    return feedback(spark, d).groupBy("source_id").agg(F.count_if(F.col("kind") == "conflict").alias("conflicts"), F.count_if(F.col("kind") != "conflict").alias("rest"))


@plan("tr_decay", "SELECT event_id AS id, round(greatest(0.1::DOUBLE, least(0.95::DOUBLE, 0.5::DOUBLE + (value / 500 - 0.5::DOUBLE) * exp(-0.01::DOUBLE * (date_sub('second', ts, TIMESTAMP '2024-06-01 00:00:00') / 86400.0::DOUBLE)))), 6) AS trust FROM events")
def _(spark, d):
    days = F.timestamp_diff("SECOND", F.col("ts"), F.expr("TIMESTAMP '2024-06-01'")) / 86400.0
    return events(spark, d).select(F.col("event_id").alias("id"), F.round(scalar.decayed_trust(F.col("value") / 500, days), 6).alias("trust"))


@plan("tr_consensus", "SELECT user_id, round(coalesce(sum((value/500)*(value/500)*(value/500)) / nullif(sum((value/500)*(value/500)), 0), 0.5), 6) AS trust FROM events GROUP BY user_id")
def _(spark, d):
    return conflict.consensus_trust(events(spark, d).withColumn("t", F.col("value") / 500), ["user_id"], "t").withColumn("trust", F.round("trust", 6))


@plan("tr_category", "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 0.8::DOUBLE WHEN 'MACHINERY' THEN 0.7::DOUBLE WHEN 'HOUSEHOLD' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS trust FROM customer")
def _(spark, d):
    cat = F.when(F.col("c_mktsegment") == "BUILDING", "User").when(F.col("c_mktsegment") == "MACHINERY", "System").when(F.col("c_mktsegment") == "HOUSEHOLD", "Derived").otherwise("External")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), scalar.base_trust(cat).alias("trust"))


@plan("cf_resolve", _RESOLVED + "SELECT id, kind AS conflict_type, strategy, round(conf, 6) AS confidence, CASE WHEN conf IS NOT NULL THEN review END AS needs_review FROM r")
def _(spark, d):
    """Every conflict with its strategy and what that decides; null where it is deferred to someone."""
    r = resolved(spark, d)
    return r.select("id", "conflict_type", "strategy", F.round("result.confidence", 6).alias("confidence"), F.col("result.needs_review").alias("needs_review"))


@plan("cr_new_fact", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS subject, event_type AS predicate, 'web=1' AS clock, CAST(1 AS BIGINT) AS lamport, 'web' AS created_by, false AS is_derived, CAST(0 AS INT) AS n_tags, true AS fresh FROM events")
def _(spark, d):
    f = facts(spark, d).select("id", "subject", "predicate", "object", "confidence", F.col("f.sources").alias("sources"))
    clock = F.array_join(F.transform(F.map_entries("vector_clock"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return crdt.new_facts(f, "web", F.expr("TIMESTAMP '2024-01-01'")).select("id", "subject", "predicate", clock.alias("clock"), "lamport", "created_by", "is_derived", F.size("tags").alias("n_tags"), F.col("supersedes").isNull().alias("fresh"))


@plan("cf_set_trust", "SELECT 'u0' AS source_id, 1.0::DOUBLE AS value UNION ALL SELECT 'x', 0.0::DOUBLE UNION ALL SELECT 'u' || i, round(0.15::DOUBLE * (i + 1) + 0.1::DOUBLE, 6) FROM range(1, 4) t(i) UNION ALL SELECT 'e' || i, round(0.15::DOUBLE * (i + 1), 6) FROM range(2) t(i)")
def _(spark, d):
    given = spark.createDataFrame([("u0", 1.5), ("x", -0.2)], "source_id string, value double")
    return conflict.set_trust(trust(spark), given).withColumn("value", F.round("value", 6))


@plan("tr_reset", _FOLD + "SELECT source AS source_id, round(v, 6) AS value FROM z WHERE source <> 'src9'")
def _(spark, d):
    gone = spark.createDataFrame([("src9",)], "source_id string")
    return conflict.reset_trust(conflict.fold_trust(feedback(spark, d)), gone).select("source_id", F.round("value", 6).alias("value"))


@plan("tr_performance", _FOLD + "SELECT source AS source_id, ok AS successes, bad AS failures, con AS conflicts, round(avg, 6) AS avg_confidence FROM z WHERE source = 'src9'")
def _(spark, d):
    return conflict.performance(conflict.fold_trust(feedback(spark, d)), "src9").withColumn("avg_confidence", F.round("avg_confidence", 6))
