"""Conflict detection and deterministic resolution over pairs of facts, and source trust.

Facts are structs ``id, subject, predicate, object (JSON text), created_at, confidence, sources``; pairs have the
columns ``e`` (existing) and ``n`` (new).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import scalar

# The strategy of each conflict type, and the types resolved without outside knowledge.
DEFAULT_STRATEGY = {
    "TemporalSupersession": "KeepNewest", "AttributeUpdate": "MergeViaCRDT", "ContradictoryFacts": "TrustHigherSource", "PartialOverlap": "MergeViaCRDT",
    "CausalChain": "ApplyLogicRules", "SourceDisagreement": "ConsensusVoting", "DuplicateInformation": "KeepNewest", "ReferenceAmbiguity": "DeferToUser",
}
DETERMINISTIC = ("TemporalSupersession", "AttributeUpdate", "DuplicateInformation")
EXTERNAL = ("ConsensusVoting", "DomainSpecificRules")


def contradictory(a: Column, b: Column) -> Column:
    """True against false, or a JSON string against ``not_`` and the same."""
    flags = ("true", "false")
    text = lambda x: F.when(x.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v"))
    ta, tb = text(a), text(b)
    return F.coalesce((a.isin(*flags) & b.isin(*flags) & (a != b)) | (ta == F.concat(F.lit("not_"), tb)) | (tb == F.concat(F.lit("not_"), ta)), F.lit(False))


def partial_overlap(a: Column, b: Column) -> Column:
    """Objects that share some names but not all."""
    ka, kb = F.json_object_keys(a), F.json_object_keys(b)
    both, all_ = F.size(F.array_intersect(ka, kb)), F.size(F.array_union(ka, kb))
    return F.coalesce(ka.isNotNull() & kb.isNotNull() & (both > 0) & (both < all_), F.lit(False))


def duplicate(e: Column, n: Column) -> Column:
    return (e["subject"] == n["subject"]) & (e["predicate"] == n["predicate"]) & (e["object"] == n["object"])


def conflict_type(e: Column, n: Column, strict: bool = False) -> Column:
    """The first type that fits. By default a duplicate is tested where it cannot occur, as the semantics have it; ``strict`` tests it first."""
    same = (e["subject"] == n["subject"]) & (e["predicate"] == n["predicate"])
    kind = F.when(same & contradictory(e["object"], n["object"]), "ContradictoryFacts").when(same & (e["created_at"] < n["created_at"]), "TemporalSupersession").when(same & partial_overlap(e["object"], n["object"]), "PartialOverlap").when(same, "AttributeUpdate")
    kind = kind.when(e["sources"] != n["sources"], "SourceDisagreement").when(duplicate(e, n), "DuplicateInformation").otherwise("ReferenceAmbiguity")
    return F.when(duplicate(e, n), "DuplicateInformation").otherwise(kind) if strict else kind


def default_strategy(kind: Column) -> Column:
    names = [F.lit(x) for pair in DEFAULT_STRATEGY.items() for x in pair]
    return F.element_at(F.create_map(*names), kind)


def strategies(conflicts: DataFrame, precedents: DataFrame, domains: list[str], key: str = "id") -> DataFrame:
    """Add ``strategy``: the best successful precedent of the type over 0.8, else the domain's rules, else the default.

    The best precedent of a type is one row, so the joined table has eight rows at most.
    """
    best = precedents.where("success").groupBy("conflict_type").agg(F.max_by("strategy", F.struct("relevance", "strategy")).alias("_s"), F.max("relevance").alias("_r"))
    df = conflicts.join(best, "conflict_type", "left")
    domain = F.when(F.col("domain").isin(domains), "DomainSpecificRules") if domains else F.lit(None).cast("string")
    return df.withColumn("strategy", F.coalesce(F.when(F.col("_r") > 0.8, F.col("_s")), domain, default_strategy(F.col("conflict_type")))).drop("_s", "_r")


def with_source_trust(pairs: DataFrame, trust: DataFrame, key: str = "id") -> DataFrame:
    """Add ``e_trust`` and ``n_trust`` (mean source trust, 0.5 where unknown or without sources, times confidence) and ``e_votes``, ``n_votes`` (sums)."""
    for side in ("e", "n"):
        each = pairs.select(key, F.explode(F.col(side)["sources"]).alias("source_id")).join(trust.select("source_id", "value"), "source_id", "left")
        got = each.groupBy(key).agg(F.avg(F.coalesce("value", F.lit(0.5))).alias("_a"), F.sum(F.coalesce("value", F.lit(0.5))).alias("_v"))
        pairs = pairs.join(got, key, "left").withColumn(f"{side}_trust", F.coalesce("_a", F.lit(0.5)) * F.col(side)["confidence"]).withColumn(f"{side}_votes", F.coalesce("_v", F.lit(0.0))).drop("_a", "_v")
    return pairs


def with_support(pairs: DataFrame, related: DataFrame, key: str = "id") -> DataFrame:
    """Add ``e_support`` and ``n_support``: related facts whose object is the fact's subject or whose subject is its object."""
    objects, subjects = related.groupBy(F.col("object").alias("_k")).agg(F.count("*").alias("_o")), related.groupBy(F.col("subject").alias("_k")).agg(F.count("*").alias("_s"))
    for side in ("e", "n"):
        f = F.col(side)
        pairs = pairs.withColumn("_x", f["subject"]).withColumn("_y", f["object"])
        pairs = pairs.join(objects, pairs["_x"] == objects["_k"], "left").drop("_k").join(subjects, pairs["_y"] == subjects["_k"], "left").drop("_k")
        pairs = pairs.withColumn(f"{side}_support", F.coalesce("_o", F.lit(0)) + F.coalesce("_s", F.lit(0))).drop("_o", "_s", "_x", "_y")
    return pairs


def _result(winner: Column, confidence: Column, review: Column) -> Column:
    return F.struct(winner.alias("winner"), confidence.cast("double").alias("confidence"), review.alias("needs_review"))


def keep_newest(e: Column, n: Column) -> Column:
    return _result(F.when(e["created_at"] < n["created_at"], "new").otherwise("existing"), F.lit(0.95), F.lit(False))


def keep_oldest(e: Column, n: Column) -> Column:
    return _result(F.when(e["created_at"] < n["created_at"], "existing").otherwise("new"), F.lit(0.9), F.lit(False))


def merge_crdt(existing_wins: Column) -> Column:
    return _result(F.when(existing_wins, "existing").otherwise("new"), F.lit(0.85), F.lit(False))


def trust_higher(e_trust: Column, n_trust: Column) -> Column:
    top = F.greatest(e_trust, n_trust)
    return _result(F.when(e_trust > n_trust, "existing").otherwise("new"), top, top < 0.7)


def logic_rules(e: Column, n: Column, e_support: Column, n_support: Column) -> Column:
    ok = ~contradictory(e["object"], n["object"])
    return _result(F.when(ok, "both").when(n_support > e_support, "new").otherwise("existing"), F.when(ok, 0.8).otherwise(0.75), ~ok)


def version_branching() -> Column:
    """Both stay, each with 0.8 of its confidence."""
    return _result(F.lit("both"), F.lit(0.7), F.lit(True))


def consensus(e: Column, n: Column, e_votes: Column, n_votes: Column) -> Column:
    """The content with more trust behind it, never reviewed; equal contents share one vote. Without votes the existing fact stays, to be reviewed."""
    total = e_votes + n_votes
    winner = F.when(duplicate(e, n) | (total == 0), "existing").when(n_votes > e_votes, "new").otherwise("existing")
    share = F.when(total == 0, F.lit(None)).when(duplicate(e, n), F.lit(1.0)).otherwise(F.greatest(e_votes, n_votes) / F.when(total != 0, total))
    return _result(winner, share, total == 0)


def domain_rules(e: Column, n: Column, priority: list[str], immutable: list[str]) -> Column:
    """The existing fact where an immutable attribute would change; else it too, renewed if a priority attribute is in the new one."""
    value = lambda o, k: F.get_json_object(o, f"$.{k}")
    changed = F.lit(False)
    for k in immutable:
        changed |= F.coalesce(value(e["object"], k) != value(n["object"], k), F.lit(False))
    return _result(F.lit("existing"), F.when(changed, 0.95).otherwise(0.85), F.lit(False))


def domain_renewed(n: Column, priority: list[str]) -> Column:
    keys = F.json_object_keys(n["object"])
    return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, priority))), F.lit(False))


def resolve(pairs: DataFrame, existing_wins: Column, priority: list[str], immutable: list[str]) -> DataFrame:
    """Add ``result`` (``winner, confidence, needs_review``) by ``strategy``; null where it is deferred to someone."""
    e, n, s = F.col("e"), F.col("n"), F.col("strategy")
    result = F.when(s == "KeepNewest", keep_newest(e, n)).when(s == "KeepOldest", keep_oldest(e, n)).when(s == "MergeViaCRDT", merge_crdt(existing_wins)).when(s == "TrustHigherSource", trust_higher(F.col("e_trust"), F.col("n_trust")))
    result = result.when(s == "ApplyLogicRules", logic_rules(e, n, F.col("e_support"), F.col("n_support"))).when(s == "VersionBranching", version_branching()).when(s == "ConsensusVoting", consensus(e, n, F.col("e_votes"), F.col("n_votes"))).when(s == "DomainSpecificRules", domain_rules(e, n, priority, immutable))
    return pairs.withColumn("result", result)


def resolution_stats(resolved: DataFrame, by: str) -> DataFrame:
    """Counts and mean confidence of resolved conflicts by type or strategy."""
    return resolved.where("result is not null").groupBy(by).agg(F.count("*").alias("n"), F.avg("result.confidence").alias("avg_confidence"), F.count_if(F.col("result.needs_review")).alias("n_review"), F.count_if(F.col("strategy").isin(*EXTERNAL)).alias("n_external"))


def success_rate(resolved: DataFrame) -> DataFrame:
    good = (F.col("result.confidence") > 0.7) & ~F.col("result.needs_review")
    return resolved.where("result is not null").agg(F.avg(good.cast("int")).alias("success_rate"))


def fold_trust(events: DataFrame, source: str = "source_id") -> DataFrame:
    """``source, value, successes, failures, conflicts, avg_confidence`` after the ordered events of each source.

    Events have ``seq, kind (update, conflict, category), success, confidence, category``. The update depends on the order, so
    one source's events are folded in one row; sources are many and events a source few.
    """
    start = F.struct(F.lit(0.5).alias("v"), F.lit(0).alias("ok"), F.lit(0).alias("bad"), F.lit(0).alias("conf"), F.lit(0.0).alias("avg"), F.lit("External").alias("cat"), F.lit(False).alias("known"))
    stretch = lambda c: F.when(c == "User", 1.2).when(c == "System", 1.1).when(c == "Derived", 0.9).otherwise(1.0)

    def step(s: Column, x: Column) -> Column:
        upd, con = x["kind"] == "update", x["kind"] == "conflict"
        ok = s["ok"] + F.when(upd & x["success"], 1).otherwise(0)
        bad = s["bad"] + F.when(upd & ~x["success"], 1).otherwise(0)
        n = F.greatest(ok + bad, F.lit(1))
        avg = F.when(upd, (s["avg"] * (n - 1) + x["confidence"]) / n).otherwise(s["avg"])
        moved = s["v"] * 0.9 + ok / n * x["confidence"] * 0.1
        moved = scalar.clamp(F.lit(0.5) + (moved - 0.5) * stretch(s["cat"]), 0.1, 0.95)
        fallen = F.when(s["known"], F.greatest(F.lit(0.1), s["v"] - 0.02)).otherwise(s["v"])
        v = F.when(upd, moved).when(con, fallen).otherwise(scalar.base_trust(x["category"]))
        cat = F.when(x["kind"] == "category", x["category"]).otherwise(s["cat"])
        return F.struct(v.alias("v"), ok.alias("ok"), bad.alias("bad"), (s["conf"] + con.cast("int")).alias("conf"), avg.alias("avg"), cat.alias("cat"), (s["known"] | ~con).alias("known"))

    ordered = F.sort_array(F.collect_list(F.struct("seq", "kind", "success", "confidence", "category")))
    g = events.groupBy(source).agg(ordered.alias("_e")).select(source, F.aggregate("_e", start, step).alias("s"))
    return g.select(source, F.col("s.v").alias("value"), F.col("s.ok").alias("successes"), F.col("s.bad").alias("failures"), F.col("s.conf").alias("conflicts"), F.col("s.avg").alias("avg_confidence"))


def consensus_trust(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Trust-weighted trust: cubes over squares; one half where squares sum up to 0."""
    t = F.col(value)
    return values.groupBy(*keys).agg(F.coalesce(F.sum(t * t * t) / F.nullif(F.sum(t * t), F.lit(0.0)), F.lit(0.5)).alias("trust"))


def set_trust(trust: DataFrame, given: DataFrame) -> DataFrame:
    """``source_id, value``: trust with what is ``given`` (one row a source) put in its place, within 0 and 1."""
    clamped = given.select("source_id", scalar.clamp(F.col("value"), 0.0, 1.0).alias("value"))
    return trust.select("source_id", "value").join(given.select("source_id"), "source_id", "left_anti").unionByName(clamped)


def reset_trust(folded: DataFrame, sources: DataFrame) -> DataFrame:
    """Folded trust without the scores and histories of ``sources`` (``source_id``)."""
    return folded.join(sources.select("source_id"), "source_id", "left_anti")


def performance(folded: DataFrame, source_id: str) -> DataFrame:
    """What is known of one source; no row where nothing is."""
    return folded.where(F.col("source_id") == source_id).select("source_id", "successes", "failures", "conflicts", "avg_confidence")
