"""Edge rows of the library's operators that the test tables lack."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memlake.engine import Engine, InvalidOperation, NotFound, new_intention, new_text, parse_trigger
from memlake.functions import bits, scalar
from memlake.operators import conflict, crdt, graph, hdc, memory, records
from memlake.sources.config import Config
from memlake.sources.graph_store import GraphStore
from memlake.sources.store import MemoryStore
from memlake.streaming import fold

T0 = dt.datetime(2024, 1, 1)


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_expressions(spark):
    r = one(
        spark, v1=scalar.valence(F.lit(0.3)), v2=scalar.valence(F.lit(-0.31)), p=scalar.pad(F.lit(1.5), F.lit(-2), F.lit(0)), c0=scalar.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
        c1=scalar.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))), c2=scalar.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), e=scalar.clock_order(F.expr("map('a', 1)"), F.expr("map('b', 1)")),
        g=scalar.clock_order(F.expr("map('a', 2)"), F.expr("map('a', 1)")), eq=scalar.clock_order(F.expr("map('a', 0)"), F.expr("map('b', 0)")), t=F.size(scalar.tokens(F.lit("  "))), d=scalar.decayed_trust(F.lit(None).cast("double"), F.lit(3.0)),
    )
    assert (r.v1, r.v2, tuple(r.p)) == ("neutral", "negative", (1.0, -1.0, 0.0)) and (r.c0, r.c1, r.c2) == (0.0, 1.0, 0.0)
    assert (r.e, r.g, r.eq, r.t, r.d) == ("concurrent", "greater", "equal", 0, 0.5)


def test_bits(spark):
    a, b = bits.random_vector(F.lit("a"), 100), bits.random_vector(F.lit("b"), 100)
    r = one(spark, same=bits.bind(bits.bind(a, b), b) == a, rot=bits.rotate(bits.rotate(a, 37, 100), -37, 100) == a, ones=bits.count_ones(bits.ones(100)), back=bits.unpack_bytes(bits.pack_bytes(a), 100) == a, sim=bits.similarity(a, a, 100), flip=bits.hamming(a, bits.flip_bit(a, 99)), out=bits.get_bit(a, F.lit(500)), set=bits.get_bit(bits.set_bit(bits.zeros(100), 40, True), F.lit(40)))
    assert r.same and r.rot and r.back and (r.ones, r.sim, r.flip, r.out, r.set) == (100, 1.0, 1, None, 1)


def test_encoders_agree(spark):
    texts = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, None), (4, "x"), (5, "q w e r t y " * 40)], "id long, t string")
    slow = {r.id: r.hv for r in hdc.encode_sequences(texts, "id", "t", 256).collect()}
    fast = {r.id: r.hv for r in hdc.encode_texts(texts.repartition(3), "id", "t", 256).collect()}
    assert slow == fast == {i: hdc.encode_text(t, 256) for i, t in ((1, "a b a c"), (2, ""), (3, None), (4, "x"), (5, "q w e r t y " * 40))}
    assert slow[4] == one(spark, v=bits.random_vector(F.lit("x"), 256)).v


def test_recall_fold_matches_sequence_and_stream(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.randrange(6), T0 + dt.timedelta(seconds=i), rnd.random() < 0.7) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, ok boolean")
    ok = F.col("ok")
    got = {r.k: r for r in memory.fold_recalls(df, "k", F.lit(0.6), ok, ~ok).collect()}
    for k, r in got.items():
        s, base = 1.0, 0.6
        for _, _, good in (x for x in rows if x[0] == k):
            s, base = (s * 1.5, min(1.0, base * 1.05)) if good else (s * 0.9, base)
        assert abs(r.stability / s - 1) < 1e-9 and abs(r.base_retention - base) < 1e-9
    df.repartition(4).write.parquet(str(tmp_path / "e"))
    q = fold.start(fold.fold_recalls(fold.read_events(spark, str(tmp_path / "e"), "k long, ts timestamp, ok boolean"), "k", F.lit(0.6), ok, ~ok), "folded", str(tmp_path / "c"))
    q.awaitTermination(60)
    assert {r.k: r for r in spark.table("folded").collect()} == got


def test_graph_and_crdt(spark):
    edges = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("c", "a", "R"), ("a", "a", "R"), ("a", "b", "R"), ("x", "a", "S")], "src string, dst string, relationship string")
    hops = lambda *a, **k: {(r.id, r.hops) for r in graph.neighbors(edges, "a", *a, **k).collect()}
    assert hops(2) == {("b", 1), ("c", 2)} and hops(0) == set() and hops(1, direction="both") == {("b", 1), ("c", 1), ("x", 1)} and hops(3, ["S"]) == set()
    ops = spark.createDataFrame([("s", "a", "add", 1), ("s", "a", "remove", 2), ("s", "a", "add", 3), ("s", "b", "add", 1), ("s", "b", "remove", 1), ("s", "c", "remove", 1)], "set_id string, elem string, op string, ts int")
    assert [r.elem for r in crdt.lww(ops, ["set_id"] + ["elem"]).collect()] == ["a"]


def test_engine(spark, tmp_path):
    src = F.struct(F.lit("u").alias("source_id"), F.lit("DirectUserInput").alias("source_type"), F.lit(0.9).alias("confidence"), F.lit(T0).alias("timestamp"))
    now, later = F.lit(T0), F.lit(T0 + dt.timedelta(days=3))
    e = Engine(MemoryStore(spark, str(tmp_path / "m")), Config().with_forgetting_threshold(1.5).with_(forgetting_threshold=0.1), dim=512)
    e.initialize()
    e.add(new_text(spark.createDataFrame([("1", "the quick brown fox"), ("2", "cooking recipes"), ("3", None)], "id string, text string").withColumn("source", src), now), now)
    trigger = parse_trigger(F.lit('{"type":"immediate"}'))
    e.add(new_intention(spark.createDataFrame([("4", "call", 1.5)], "id string, goal string, priority double").withColumn("source", src).withColumn("trigger", trigger), now), now)
    assert [r.id for r in e.search("the quick brown fox", 1, later).collect()] == ["1"]
    assert [r.id for r in e.triggerable_intentions(later).collect()] == ["4"] and e.active_intentions().first().priority == 1.0
    before, n = e.get("1").first(), e.store.list_ids().count()
    e.get("1", later)
    e.search("the quick brown fox", 1, later, ts=later)
    after = e.get("1").first()
    assert n == 4 and after.access_count == before.access_count + 2 and after.stability > before.stability and after.last_recall == T0 + dt.timedelta(days=3)
    assert e.get("2").first().access_count == 0
    assert (e.stats().first().total_memories, e.stats().first().total_searches, e.stats().first().recalls) == (4, 1, 2)
    assert {r.id for r in e.candidates("retention", later, 0.0).collect()} == {"1", "2", "3", "4"}
    with pytest.raises(InvalidOperation):
        e.candidates("guess", later, 0.0)
    e.complete("4", later)
    assert e.active_intentions().count() == 0
    with pytest.raises(InvalidOperation):
        e.cancel("1", later)
    e.update_emotion(spark.createDataFrame([("1", (0.8, 0.5, 0.4))], "id string, pad struct<pleasure:double,arousal:double,dominance:double>"), later)
    assert e.search_emotion("positive", 5, later).first().id == "1" and e.emotion_stats().first().n_positive == 1
    e.delete(spark.createDataFrame([("2",)], "id string"), later)
    with pytest.raises(NotFound):
        e.get("2")
    assert e.forget(later, later) == 2 and [r.id for r in e.store.list_ids().collect()] == ["1"] and e.stats().first().total_forgotten == 2


def test_record_logs(spark):
    log = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, False, None), ("b", 1, False, "y"), ("b", 2, True, None), ("c", 1, True, None), ("c", 2, False, "z"), (None, 1, False, "n")], "id string, seq int, deleted boolean, v string")
    assert {(r.id, r.v) for r in records.latest(log, "id", ["seq"], "deleted").collect()} == {("a", None), ("c", "z"), (None, "n")}
    assert {r.id: (r.written, r.deletions) for r in records.versions(log, "id", "deleted").collect()}["b"] == (1, 1)
    ids = spark.createDataFrame([("a",), ("q",), ("q",)], "id string")
    assert [r.id for r in records.missing(ids, log).collect()] == ["q"]
    known = log.where("id is not null and seq = 1")
    assert [r.id for r in records.paged(known, F.lit("a"), 1).collect()] == ["b"] and records.paged(known, None, 9).count() == 3
    assert records.latest(log.limit(0), "id", ["seq"], "deleted").collect() == []


def test_bind_all_and_most_similar(spark):
    v = spark.createDataFrame([(1, "g", [5, 9]), (2, "g", [3, 1]), (3, "h", [7, 7]), (4, "e", None)], "id int, k string, hv array<bigint>")
    assert {r.k: r.hv for r in hdc.bind_all(v, ["k"], "hv").collect()} == {"g": [6, 8], "h": [7, 7]}
    assert [(r.id, r.distance) for r in hdc.most_similar(v.where("hv is not null"), [7, 7], 64, 2, "id", "hv").collect()] == [(3, 0), (2, 3)]


def test_graph_store(spark, tmp_path):
    g, t = GraphStore(spark, str(tmp_path / "g")), F.lit(T0)
    g.initialize()
    nodes = spark.createDataFrame([("a", ["Person"], {"name": "Alice"}), ("b", ["Person"], {}), ("c", [], None)], "id string, labels array<string>, properties map<string,string>")
    g.create_nodes(nodes, t, 1)
    edge = lambda *rows: spark.createDataFrame(rows, "src string, dst string, relationship string")
    g.create_edges(edge(("a", "b", "KNOWS"), ("b", "c", "KNOWS"), ("a", "b", "KNOWS"), ("b", "b", "SELF")), t, 2)
    with pytest.raises(NotFound):
        g.create_edges(edge(("a", "c", "KNOWS"), ("a", "x", "KNOWS")), t, 3)
    assert g.get_node("a").first().properties == {"name": "Alice"} and tuple(g.counts().first()) == (3, 4)
    assert {(r.id, r.hops) for r in g.neighbors("a", 2).collect()} == {("b", 1), ("c", 2)}
    assert g.query("SELECT count(*) AS n FROM {edges} e JOIN {nodes} n ON n.id = e.dst WHERE e.relationship = :r", r="KNOWS").first().n == 3
    g.delete_node("b", t, 4)
    assert tuple(g.counts().first()) == (2, 0)
    g.create_nodes(nodes.where("id = 'b'"), t, 5)  # what comes after a deletion stays
    g.create_edges(edge(("c", "b", "LIKES")), t, 6)
    assert [r.src for r in g.edges().collect()] == ["c"] and g.nodes().count() == 3
    with pytest.raises(NotFound):
        g.get_node("q")


def test_trust_tables(spark):
    trust = spark.createDataFrame([("a", 0.4), ("b", 0.6)], "source_id string, value double")
    given = spark.createDataFrame([("b", 7.0), ("c", -1.0)], "source_id string, value double")
    assert {tuple(r) for r in conflict.set_trust(trust, given).collect()} == {("a", 0.4), ("b", 1.0), ("c", 0.0)}
    assert [r.source_id for r in conflict.reset_trust(trust, given).collect()] == ["a"]


def test_similarity_matrix_has_both_sides(spark):
    v = spark.createDataFrame([(1, [0]), (2, [3])], "id int, hv array<bigint>")
    assert {tuple(r) for r in hdc.similarity_matrix(v, "id", "hv", 32).collect()} == {(1, 1, 1.0), (2, 2, 1.0), (1, 2, 0.9375), (2, 1, 0.9375)}
    assert hdc.similarity_matrix(v.limit(0), "id", "hv", 32).count() == 0
    assert v.select(bits.display(F.col("hv"), 32).alias("s")).collect()[1].s == "HyperVector[32D, 6% ones]"
