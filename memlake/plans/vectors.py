"""Dense-vector, bit-vector, hybrid and keyword queries over embeddings, benchmark, part and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import bits, scalar
from memlake.operators import hdc, search

PLANS: dict = {}


def T():
    return F.expr(AS_OF)


def X():
    return F.col("x")


def Y():
    return F.col("y")
DIM = 256
AS_OF = "TIMESTAMP '2024-03-01 00:00:00'"
QUERY = "the and that then onth ing"

# In SQL a vector is the list of its eight 32-bit words; a token's words are the heads of md5 blocks.
_TOK = "tok AS (SELECT id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM src))"
_BITS = "bits AS (SELECT {keys}, b * 32 + i AS k FROM (SELECT *, CAST(('0x' || substr(md5(token || ':' || b), 1, 8)) AS BIGINT) AS w FROM {tok} CROSS JOIN (SELECT unnest(range(8)) AS b)) CROSS JOIN (SELECT unnest(range(32)) AS i) WHERE (w >> i) & 1 = 1)"
_WORDS = "hv AS (SELECT id, list(coalesce(v, 0) ORDER BY b) AS hv FROM (SELECT DISTINCT id, b FROM {src} CROSS JOIN (SELECT unnest(range(8)) AS b)) LEFT JOIN (SELECT id, j // 32 AS b, CAST(sum(CAST(1 AS BIGINT) << (j % 32)) AS BIGINT) AS v FROM won GROUP BY ALL) USING (id, b) GROUP BY id)"
_ENC = _TOK + ", " + _BITS.format(keys="id, pos", tok="tok") + ", n AS (SELECT id, count(*) AS n FROM tok GROUP BY id), won AS (SELECT id, (k + pos) % 256 AS j FROM bits JOIN n USING (id) GROUP BY id, (k + pos) % 256, n HAVING 2 * count(*) > n), " + _WORDS.format(src="src")
_BENCH = "WITH src AS (SELECT item_id AS id, text FROM benchmark), " + _ENC


def _ham(a, b):
    return f"list_sum(list_transform(range(1, 9), lambda i: bit_count(xor({a}[i], {b}[i]))))"


def _sum(v):
    return f"list_sum(list_transform({v}, lambda w: bit_count(w)))"


_MEM = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(id)"
_SCORED = f", q AS (SELECT {hdc.encode_text(QUERY, DIM)}::BIGINT[] AS q), m AS (SELECT id, hv, 1 - {_ham('hv', 'q')} / 256.0::DOUBLE AS sim, 0.9::DOUBLE * exp(-date_sub('second', {_MEM}, {AS_OF}) / ((1 + id % 5)::DOUBLE * 86400)) AS st, {_MEM} AS created_at FROM hv, q), r AS (SELECT *, 0.7::DOUBLE * sim + (1 - 0.7::DOUBLE) * st AS score FROM m) "


def plan(name, sql=None):
    def add(f):
        PLANS[name] = (f, sql)
        return f

    return add


def bench(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")


def encoded(spark, d):
    return hdc.encode_sequences(bench(spark, d), "id", "text", DIM)


def _aged(df):
    return df.select("*", F.timestamp_add("HOUR", F.col("id"), F.expr("TIMESTAMP '2024-01-01'")).alias("created_at"), F.lit(0.9).alias("base_retention"), (F.lit(1.0) + F.col("id") % 5).alias("stability")).withColumn("last_recall", F.col("created_at"))


@plan("vs_cosine_topk", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")
    q = e.orderBy("id").first().dense
    return search.search_dense(e, q, 20).select("id", F.round("score", 6).alias("score"))


@plan("vs_cosine_filter", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 10")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")
    return search.search_dense(e, e.orderBy("id").first().dense, 10, F.col("label") == 3).select("id", F.round("score", 6).alias("score"))


@plan("hv_encode", _BENCH + f" SELECT id, CAST({_sum('hv')} AS INT) AS ones, array_to_string(hv, ',') AS words FROM hv")
def _(spark, d):
    return encoded(spark, d).select("id", bits.count_ones(F.col("hv")).alias("ones"), F.array_join(F.col("hv").cast("array<string>"), ",").alias("words"))


@plan("hv_encode_documents", None)
def _(spark, d):
    """Whole documents at 1,024 bits by the Arrow path; tests hold it against the voting path."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return hdc.encode_texts(docs, "doc_id", "text", 1024).select("doc_id", bits.count_ones(F.col("hv")).alias("ones"), F.array_join(F.col("hv").cast("array<string>"), ",").alias("words"))


@plan("vs_hdc_topk", _BENCH + _SCORED + "SELECT id, round(sim, 6) AS similarity, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 10")
def _(spark, d):
    """The flagship: 0.7 similarity + 0.3 retention, top 10."""
    return search.search_bits(_aged(encoded(spark, d)), hdc.encode_text(QUERY, DIM), DIM, T(), 10).select("id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@plan("vs_hdc_threshold", _BENCH + _SCORED + "SELECT id, round(score, 6) AS score FROM r WHERE sim >= 0.5")
def _(spark, d):
    return search.search_threshold(_aged(encoded(spark, d)), hdc.encode_text(QUERY, DIM), DIM, T(), 0.5).select("id", F.round("score", 6).alias("score"))


@plan("vs_hdc_temporal", _BENCH + _SCORED + "SELECT id, round(score, 6) AS score FROM r WHERE created_at >= TIMESTAMP '2024-01-01 05:00:00' AND created_at <= TIMESTAMP '2024-01-02 02:00:00' ORDER BY r.score DESC, id LIMIT 8")
def _(spark, d):
    since, until = F.expr("TIMESTAMP '2024-01-01 05:00:00'"), F.expr("TIMESTAMP '2024-01-02 02:00:00'")
    return search.search_temporal(_aged(encoded(spark, d)), hdc.encode_text(QUERY, DIM), DIM, T(), 8, since, until).select("id", F.round("score", 6).alias("score"))


_PAIR = _BENCH + ", p AS (SELECT a.id AS i, b.id AS j, a.hv AS x, b.hv AS y FROM hv a JOIN hv b ON b.id = a.id + 1) "


def pairs(spark, d):
    v = encoded(spark, d)
    return v.select(F.col("id").alias("i"), F.col("hv").alias("x")).join(v.select((F.col("id") - 1).alias("i"), F.col("id").alias("j"), F.col("hv").alias("y")), "i")




@plan("hv_bind", _PAIR + "SELECT i, array_to_string(list_transform(range(1, 9), lambda k: xor(x[k], y[k])), ',') AS bound FROM p")
def _(spark, d):
    return pairs(spark, d).select("i", F.array_join(bits.bind(X(), Y()).cast("array<string>"), ",").alias("bound"))


@plan("hv_hamming", _PAIR + f"SELECT i, j, CAST({_ham('x', 'y')} AS INT) AS distance, round(1 - {_ham('x', 'y')} / 256.0::DOUBLE, 6) AS similarity FROM p")
def _(spark, d):
    return pairs(spark, d).select("i", "j", bits.hamming(X(), Y()).alias("distance"), F.round(bits.similarity(X(), Y(), DIM), 6).alias("similarity"))


_AND = "list_sum(list_transform(range(1, 9), lambda k: bit_count(x[k] & y[k])))"
_OR = "list_sum(list_transform(range(1, 9), lambda k: bit_count(x[k] | y[k])))"


@plan("hv_jaccard", _PAIR + f"SELECT i, round({_AND} / ({_OR})::DOUBLE, 6) AS jaccard FROM p")
def _(spark, d):
    return pairs(spark, d).select("i", F.round(bits.jaccard(X(), Y()), 6).alias("jaccard"))


@plan("hv_ngdot", _PAIR + f"SELECT i, CAST({_AND} AS INT) AS dot, round({_AND} / sqrt(({_sum('x')} * {_sum('y')})::DOUBLE), 6) AS normalized FROM p")
def _(spark, d):
    return pairs(spark, d).select("i", bits.shared(X(), Y()).alias("dot"), F.round(bits.normalized_dot(X(), Y()), 6).alias("normalized"))


@plan("hv_matrix", _BENCH + f" SELECT a.id AS i, b.id AS j, round(1 - {_ham('a.hv', 'b.hv')} / 256.0::DOUBLE, 6) AS sim FROM hv a JOIN hv b ON a.id < b.id")
def _(spark, d):
    return hdc.similarity_pairs(encoded(spark, d), "id", "hv", DIM).withColumn("sim", F.round("sim", 6))


@plan("hv_closest_pair", _BENCH + f" SELECT a.id AS i, b.id AS j, round(1 - {_ham('a.hv', 'b.hv')} / 256.0::DOUBLE, 6) AS sim FROM hv a JOIN hv b ON a.id < b.id ORDER BY 1 - {_ham('a.hv', 'b.hv')} / 256.0::DOUBLE DESC, i, j LIMIT 1")
def _(spark, d):
    return hdc.similarity_pairs(encoded(spark, d), "id", "hv", DIM).orderBy(F.desc("sim"), "i", "j").limit(1).withColumn("sim", F.round("sim", 6))


@plan("hv_permute", _BENCH + ", rot AS (SELECT id, (b * 32 + i + 37) % 256 AS j FROM hv, (SELECT unnest(range(8)) AS b), (SELECT unnest(range(32)) AS i) WHERE (hv[b + 1] >> i) & 1 = 1) SELECT id, CAST(count(*) AS BIGINT) AS ones, CAST(sum(j * (j + 1)) AS BIGINT) AS mark FROM rot GROUP BY id")
def _(spark, d):
    b = encoded(spark, d).select("id", F.explode(bits.bits_of(bits.rotate(F.col("hv"), 37, DIM))).alias("j")).withColumn("j", F.col("j").cast("long"))
    return b.groupBy("id").agg(F.count("*").alias("ones"), F.sum(F.col("j") * (F.col("j") + 1)).alias("mark"))


_SYMBOL = "list_transform(range(8), lambda b: CAST(('0x' || substr(md5({s} || ':' || b), 1, 8)) AS BIGINT))"


def _vec(s):
    return _SYMBOL.format(s=s)


def _codes(spark, d):
    types = spark.read.parquet(f"{d}/part.parquet").select("p_type").distinct()
    return types.select(F.col("p_type").alias("symbol"), bits.random_vector(F.col("p_type"), DIM).alias("code"))


def _noisy(parts):
    """``id, v, hv``: the vector of each part's type, and the same with 16 bits flipped."""
    q = parts.select(F.col("p_partkey").alias("id"), bits.random_vector(F.col("p_type"), DIM).alias("v"))
    return q.withColumn("hv", F.transform("v", lambda w, k: F.when(k == F.col("id") % 8, w.bitwiseXOR(65535)).otherwise(w)))


@plan("hv_cleanup", f"WITH c AS (SELECT DISTINCT p_type AS symbol, {_vec('p_type')} AS code FROM part), q AS (SELECT p_partkey AS id, list_transform(range(1, 9), lambda k: xor(({_vec('p_type')})[k], CASE WHEN k = 1 + p_partkey % 8 THEN 65535 ELSE 0 END)) AS hv FROM part) SELECT id, arg_min(symbol, ROW({_ham('hv', 'code')}, symbol)) AS symbol, round(max(1 - {_ham('hv', 'code')} / 256.0::DOUBLE), 6) AS sim FROM q, c GROUP BY id")
def _(spark, d):
    """Each part's type with 16 bits flipped, cleaned up against the codebook of types."""
    q = _noisy(spark.read.parquet(f"{d}/part.parquet"))
    return hdc.cleanup(q, "id", "hv", _codes(spark, d), "symbol", "code", DIM).withColumn("sim", F.round("sim", 6))


@plan("hv_resonate", PLANS["hv_cleanup"][1].replace("AS sim FROM q, c", f"AS sim, CAST(CASE WHEN max(1 - {_ham('hv', 'code')} / 256.0::DOUBLE) >= 0.95 THEN 1 ELSE 2 END AS INT) AS iterations FROM q, c"))
def _(spark, d):
    q = _noisy(spark.read.parquet(f"{d}/part.parquet"))
    return hdc.resonate(q, "id", "hv", _codes(spark, d), "symbol", "code", DIM).withColumn("sim", F.round("sim", 6))


_NGRAM = "WITH src AS (SELECT item_id AS id, text FROM benchmark), " + _TOK + ", g AS (SELECT id, token, pos - o AS pos FROM tok CROSS JOIN (SELECT unnest(range(3)) AS o)), mx AS (SELECT id, max(pos) AS last FROM tok GROUP BY id), gg AS (SELECT g.* FROM g JOIN mx USING (id) WHERE pos >= 0 AND pos <= last - 2), " + _BITS.format(keys="id, pos", tok="gg") + ", odd AS (SELECT id, pos, k FROM bits GROUP BY ALL HAVING count(*) % 2 = 1), n AS (SELECT id, last - 1 AS n FROM mx), won AS (SELECT id, (k + pos) % 256 AS j FROM odd JOIN n USING (id) GROUP BY id, (k + pos) % 256, n HAVING 2 * count(*) > n), " + _WORDS.format(src="src")


@plan("hv_ngram", _NGRAM + " SELECT id, array_to_string(hv, ',') AS words FROM hv")
def _(spark, d):
    return hdc.encode_ngrams(bench(spark, d), "id", "text", 3, DIM).select("id", F.array_join(F.col("hv").cast("array<string>"), ",").alias("words"))


_MAPS = f"WITH e AS (SELECT p_partkey AS id, unnest(['brand', 'type', 'size']) AS k, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS v FROM part), b AS (SELECT id, list_transform(range(1, 9), lambda i: xor(({_vec('k')})[i], ({_vec('v')})[i])) AS x FROM e), won AS (SELECT id, w * 32 + i AS j FROM b, (SELECT unnest(range(8)) AS w), (SELECT unnest(range(32)) AS i) WHERE (x[w + 1] >> i) & 1 = 1 GROUP BY ALL HAVING 2 * count(*) > 3), src AS (SELECT p_partkey AS id FROM part), " + _WORDS.format(src="src")


@plan("hv_map", _MAPS + f" SELECT id, CAST({_sum('hv')} AS INT) AS ones, CAST(list_sum(hv) AS BIGINT) AS mark FROM hv")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("m"))
    return hdc.encode_maps(p, "id", "m", DIM).select("id", bits.count_ones(F.col("hv")).alias("ones"), F.aggregate("hv", F.lit(0).cast("long"), lambda s, w: s + w).alias("mark"))


_LEVEL = "least(greatest(p_retailprice, 900.0::DOUBLE), 1800.0::DOUBLE)"


@plan("hv_scalar", f"SELECT p_partkey AS id, CAST(trunc(({_LEVEL} - 900) / 900 * 99) AS INT) AS level, CAST(list_sum({_vec('''('level' || CAST(trunc((''' + _LEVEL + ''' - 900) / 900 * 99) AS INT))''')}) AS BIGINT) AS mark FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    x = F.col("p_retailprice")
    return p.select(F.col("p_partkey").alias("id"), hdc.scalar_level(x, 900.0, 1800.0, 100).alias("level"), F.aggregate(hdc.encode_scalar(x, 900.0, 1800.0, 100, DIM), F.lit(0).cast("long"), lambda s, w: s + w).alias("mark"))


def _level_words(how):
    return _vec("""('level' || CAST(""" + how + """((""" + _LEVEL + """ - 900) / 900 * 99) AS INT))""")


@plan("hv_interpolated", f"SELECT p_partkey AS id, CAST(floor(({_LEVEL} - 900) / 900 * 99) AS INT) AS low, CAST(ceil(({_LEVEL} - 900) / 900 * 99) AS INT) AS high, CAST(list_sum(list_transform(list_zip({_level_words('floor')}, {_level_words('ceil')}), lambda p: p[1] & p[2])) AS BIGINT) AS mark FROM part")
def _(spark, d):
    x = F.col("p_retailprice")
    low, high = hdc.scalar_levels(x, 900.0, 1800.0, 100)
    mark = F.aggregate(hdc.encode_interpolated(x, 900.0, 1800.0, 100, DIM), F.lit(0).cast("long"), lambda s, w: s + w)
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), low.alias("low"), high.alias("high"), mark.alias("mark"))


@plan("hv_bytes", f"SELECT p_partkey AS id, list_sum({_vec('p_brand')})::BIGINT AS mark, 32 AS n_bytes FROM part")
def _(spark, d):
    v = bits.random_vector(F.col("p_brand"), DIM)
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), bits.pack_bytes(v).alias("b"))
    return p.select("id", F.aggregate(bits.unpack_bytes(F.col("b"), DIM), F.lit(0).cast("long"), lambda s, w: s + w).alias("mark"), F.octet_length("b").alias("n_bytes"))


_TRIPLE = f"t AS (SELECT p_brand AS id, list_transform(range(1, 9), lambda i: xor(xor(({_vec('p_type')})[i], ({_vec(chr(39) + 'has_size' + chr(39))})[i]), ({_vec('CAST(p_size AS VARCHAR)')})[i])) AS x FROM part)"


@plan("ext_graph_encode", f"WITH {_TRIPLE}, n AS (SELECT id, count(*) AS n FROM t GROUP BY id), won AS (SELECT id, w * 32 + i AS j FROM t JOIN n USING (id), (SELECT unnest(range(8)) AS w), (SELECT unnest(range(32)) AS i) WHERE (x[w + 1] >> i) & 1 = 1 GROUP BY id, w, i, n HAVING 2 * count(*) > n), src AS (SELECT DISTINCT id FROM t), " + _WORDS.format(src="src") + " SELECT id, CAST(list_sum(hv) AS BIGINT) AS mark FROM hv")
def _(spark, d):
    """Each brand's parts as a graph of triples (type, has_size, size), bundled."""
    t = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("id"), F.col("p_type").alias("subject"), F.lit("has_size").alias("predicate"), F.col("p_size").cast("string").alias("object"))
    return hdc.encode_graph(t, ["id"], DIM).select("id", F.aggregate("hv", F.lit(0).cast("long"), lambda s, w: s + w).alias("mark"))


@plan("ext_hybrid", _BENCH + _SCORED + ", k AS (SELECT id, count(*) / 10.0::DOUBLE AS score FROM tok WHERE token = 'the' GROUP BY id) SELECT id, round(0.7::DOUBLE * coalesce(r.score, 0) + 0.3::DOUBLE * coalesce(k.score, 0), 6) AS score FROM r FULL JOIN k USING (id) ORDER BY round(0.7::DOUBLE * coalesce(r.score, 0) + 0.3::DOUBLE * coalesce(k.score, 0), 9) DESC, id LIMIT 15")
def _(spark, d):
    a = search.search_threshold(_aged(encoded(spark, d)), hdc.encode_text(QUERY, DIM), DIM, T(), 0.0)
    b = bench(spark, d).select("id", F.size(F.filter(scalar.tokens(F.col("text")), lambda t: t == "the")).alias("n")).where("n > 0").select("id", (F.col("n") / 10.0).alias("score"))
    return search.hybrid(a, b, 0.7, 15).select("id", F.round("score", 6).alias("score"))


@plan("ext_chunk", "SELECT doc_id, i AS chunk, substr(text, CAST(i * 512 + 1 AS BIGINT), 512) AS piece FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 512.0) AS BIGINT)))) AS i FROM documents)")
def _(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(scalar.chunked(F.col("text"))).alias("chunk", "piece"))
    return t.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "piece")


@plan("ext_bm25", "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS t FROM documents), f AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'with')) AS a, len(list_filter(t, lambda x: x = 'les')) AS b FROM t), g AS (SELECT count(*) AS c, avg(n) AS avg, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f), s AS (SELECT doc_id, ln(1 + (c - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / avg)) + ln(1 + (c - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / avg)) AS score FROM f, g) SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 25")
def _(spark, d):
    return search.bm25(spark.read.parquet(f"{d}/documents.parquet"), ["with", "les"], 25, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@plan("ext_structures", _BENCH + _SCORED + "SELECT id, round(sim, 6) AS similarity FROM r WHERE sim >= 0.51")
def _(spark, d):
    return search.similar_structures(encoded(spark, d), hdc.encode_text(QUERY, DIM), DIM, 0.51).select("id", F.round("similarity", 6).alias("similarity"))


@plan("hv_matrix_full", _BENCH + f" SELECT a.id AS i, b.id AS j, round(1 - {_ham('a.hv', 'b.hv')} / 256.0::DOUBLE, 6) AS sim FROM hv a, hv b")
def _(spark, d):
    """All ordered pairs of the benchmark texts, each with itself too."""
    return hdc.similarity_matrix(encoded(spark, d), "id", "hv", DIM).withColumn("sim", F.round("sim", 6))


@plan("hv_display", _BENCH + f" SELECT id, 'HyperVector[256D, ' || CAST(trunc(CAST({_sum('hv')} / 256.0::DOUBLE AS FLOAT) * CAST(100 AS FLOAT)) AS INT) || '% ones]' AS shown FROM hv")
def _(spark, d):
    return encoded(spark, d).select("id", bits.display(F.col("hv"), DIM).alias("shown"))


@plan("hv_query_map", _MAPS + f" SELECT p.id, CAST({_ham('p.asked', 'p.held')} AS INT) AS distance FROM (SELECT hv.id, list_transform(range(1, 9), lambda i: xor(hv.hv[i], ({_vec(chr(39) + 'type' + chr(39))})[i])) AS asked, {_vec('p_type')} AS held FROM hv JOIN part ON p_partkey = hv.id) p")
def _(spark, d):
    """What each part's map holds under its type's name, against the vector of the type."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), "p_type", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("m"))
    asked = hdc.encode_maps(p, "id", "m", DIM).select("id", hdc.query_map(F.col("hv"), F.lit("type"), DIM).alias("asked"))
    held = p.select("id", F.when(F.col("p_type").isNotNull(), bits.random_vector(F.col("p_type"), DIM)).alias("held"))
    # files are far smaller than their rows in memory, so neither side may be broadcast by its size
    return asked.join(held.hint("merge"), "id").select("id", bits.hamming(F.col("asked"), F.col("held")).alias("distance"))


_CONSTRAINED = "(SELECT id, st FROM r WHERE st >= 1e-9 AND created_at <= TIMESTAMP '2024-01-02 02:00:00' AND id % 10 >= 3)"


@plan("ext_hybrid_constrained", _BENCH + _SCORED + f", k AS (SELECT id, count(*) / 10.0::DOUBLE AS score FROM tok WHERE token = 'the' GROUP BY id), h AS (SELECT id, 0.7::DOUBLE * coalesce(r.score, 0) + 0.3::DOUBLE * coalesce(k.score, 0) AS score FROM r FULL JOIN k USING (id)) SELECT id, round(log10(score * c.st), 6) AS log_score FROM h JOIN {_CONSTRAINED} c USING (id) ORDER BY score * c.st DESC, id LIMIT 15")
def _(spark, d):
    """Hybrid search times retention, over memories that are confident, retained and old enough."""
    m = _aged(encoded(spark, d)).withColumn("source", F.struct((0.5 + (F.col("id") % 10) / 20).alias("confidence"), F.lit("User").alias("source_type"))).withColumn("is_consolidated", F.lit(False))
    a = search.search_threshold(_aged(encoded(spark, d)), hdc.encode_text(QUERY, DIM), DIM, T(), 0.0)
    b = bench(spark, d).select("id", F.size(F.filter(scalar.tokens(F.col("text")), lambda t: t == "the")).alias("n")).where("n > 0").select("id", (F.col("n") / 10.0).alias("score"))
    allowed = search.constrained(m, T(), 0.64, 1e-9, False, ["User"], None, F.lit("2024-01-02 02:00:00").cast("timestamp"))
    return search.hybrid_search(a, b, allowed, 0.7, 15).select("id", F.round(F.log10("score"), 6).alias("log_score"))
