"""Bundling, encoders, clean-up and similarity search of bit vectors.

A symbol's vector is a pure function of its text, so vectors of different rows, partitions and runs
compare. Bundling is a strict majority; a tie gives 0. ``bundle_bits`` votes in the bit domain with
built-in functions; ``encode_texts`` is the Arrow path for many long texts and gives the same bits, as does that of ``encode_maps``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from memlake.functions import bits, scalar


def symbol_bits(symbols: DataFrame, symbol: str, dim: int) -> DataFrame:
    """``symbols`` with one row for each set bit ``k`` of the symbol's vector."""
    block = F.explode(F.sequence(F.lit(0), F.lit(-(-dim // 32) - 1))).alias("_b")
    words = symbols.select("*", block).withColumn("_w", F.conv(F.substring(F.md5(F.concat_ws(":", F.col(symbol), F.col("_b"))), 1, 8), 16, 10).cast("long"))
    bit = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_i")).where("(shiftright(_w, _i) & 1) = 1")
    return bit.withColumn("k", F.col("_b") * 32 + F.col("_i")).where(F.col("k") < dim).drop("_b", "_w", "_i")


def bundle_bits(members: DataFrame, keys: list[str], votes: DataFrame, dim: int) -> DataFrame:
    """Majority vectors ``keys, hv``: of ``members`` (one row a vector) from their set bits ``votes`` (``keys, j``)."""
    n = members.groupBy(*keys).agg(F.count("*").alias("_n"))
    ones = votes.groupBy(*keys, "j").agg(F.count("*").alias("_c"))
    won = ones.join(n, keys).where("2 * _c > _n").groupBy(*keys, F.floor(F.col("j") / 32).cast("int").alias("_w")).agg(F.sum(F.expr("shiftleft(1L, cast(j % 32 AS int))")).alias("_v"))
    maps = won.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_v"))).alias("_m"))
    words = F.transform(F.sequence(F.lit(0), F.lit(-(-dim // 32) - 1)), lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0).cast("long")))
    return n.join(maps, keys, "left").select(*keys, F.when(F.col("_m").isNull(), bits.zeros(dim)).otherwise(words).alias("hv"))


def encode_sequences(texts: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """``key, hv``: each token's vector rotated by its position, bundled; texts without tokens give zeros."""
    tok = texts.select(key, F.posexplode(scalar.tokens(F.col(text))).alias("pos", "token"))
    votes = symbol_bits(tok, "token", dim).select(key, F.pmod(F.col("k") + F.col("pos"), F.lit(dim)).alias("j"))
    made = bundle_bits(tok, [key], votes, dim)
    return texts.select(key).join(made, key, "left").select(key, F.coalesce("hv", bits.zeros(dim)).alias("hv"))


def encode_ngrams(texts: DataFrame, key: str, text: str, n: int, dim: int) -> DataFrame:
    """``key, hv``: XOR of the vectors of each run of ``n`` tokens, rotated by its start, bundled; shorter texts as sequences."""
    t = texts.select(key, scalar.tokens(F.col(text)).alias("_t"))
    long = t.where(F.size("_t") >= n).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_t") - n), lambda i: F.slice("_t", i + 1, n))).alias("pos", "_g"))
    gram = long.select(key, "pos", F.explode("_g").alias("token"))
    odd = symbol_bits(gram, "token", dim).groupBy(key, "pos", "k").agg(F.count("*").alias("c")).where("c % 2 = 1")
    made = bundle_bits(long, [key], odd.select(key, F.pmod(F.col("k") + F.col("pos"), F.lit(dim)).alias("j")), dim)
    short = encode_sequences(t.where(F.size("_t") < n).select(key, F.array_join("_t", " ").alias("_s")), key, "_s", dim)
    return made.unionByName(short)


def encode_maps(maps: DataFrame, key: str, entries: str, dim: int, cache_bytes: int = 1 << 26) -> DataFrame:
    """``key, hv``: the bundle of name XOR value over the entries of a key's maps; a null value votes for no bit, a null key gives zeros.

    A key's equal entries are counted before they are gathered, and Arrow batches bundle them: nothing is joined and no bit has a row.
    A task keeps the vectors of ``cache_bytes`` of names and values at most.
    """
    pairs = maps.select(key, F.explode(entries).alias("_k", "_v")).select(key, F.col("_k").cast("string").alias("_k"), F.col("_v").cast("string").alias("_v"))
    counted = pairs.groupBy(key, "_k", "_v").agg(F.count("*").alias("_c"))
    held = counted.groupBy(key).agg(F.collect_list(F.struct("_k", "_v", "_c")).alias("_e")).select(key, "_e._k", "_e._v", "_e._c")
    most = max(1, cache_bytes // (dim // 8 + 128))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def vector(symbol: str) -> int:
            if symbol not in known:
                if len(known) >= most:
                    known.clear()
                known[symbol] = _symbol(symbol, dim)
            return known[symbol]

        def votes(names: list[str], values: list[str | None], counts: list[int]) -> Iterator[int]:
            for name, value, n in zip(names, values, counts):
                yield from repeat(0 if value is None else vector(name) ^ vector(value), n)

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                made = [_bundle(votes(*row), dim) for row in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=[key, "hv"])

    made = held.mapInArrow(run, StructType([held.schema[key], StructField("hv", ArrayType(LongType()))]))
    return made.withColumn("hv", F.when(F.col(key).isNull(), bits.zeros(dim)).otherwise(F.col("hv")))


def query_map(hv: Column, name: Column, dim: int) -> Column:
    """What a map vector holds under ``name``, with noise: to be cleaned up."""
    return bits.bind(hv, bits.random_vector(name, dim))


def scalar_level(x: Column, low: float, high: float, levels: int) -> Column:
    """The level of a clamped value, truncated."""
    return ((scalar.clamp(x.cast("double"), low, high) - low) / (high - low) * (levels - 1)).cast("int")


def scalar_levels(x: Column, low: float, high: float, levels: int) -> tuple[Column, Column]:
    """The levels just below and above the value; equal where it lies on one."""
    at = (scalar.clamp(x.cast("double"), low, high) - low) / (high - low) * (levels - 1)
    return F.floor(at).cast("int"), F.ceil(at).cast("int")


def encode_scalar(x: Column, low: float, high: float, levels: int, dim: int) -> Column:
    return bits.random_vector(F.concat(F.lit("level"), scalar_level(x, low, high, levels).cast("string")), dim)


def encode_interpolated(x: Column, low: float, high: float, levels: int, dim: int) -> Column:
    """The bundle of the levels around: a tie of two is 0, so the bits that both have."""
    a, b = (bits.random_vector(F.concat(F.lit("level"), v.cast("string")), dim) for v in scalar_levels(x, low, high, levels))
    return F.zip_with(a, b, lambda p, q: p.bitwiseAND(q))


def cleanup(noisy: DataFrame, key: str, hv: str, codebook: DataFrame, symbol: str, code: str, dim: int) -> DataFrame:
    """``key, symbol, sim``: the most similar codebook vector, the smallest symbol on ties.

    Every query meets every code: a stated query set against a codebook, never rows against rows.
    """
    pairs = noisy.select(key, F.col(hv).alias("_q")).crossJoin(codebook.select(F.col(symbol).alias("symbol"), F.col(code).alias("_c")))
    scored = pairs.select(key, "symbol", bits.similarity(F.col("_q"), F.col("_c"), dim).alias("sim"))
    return scored.groupBy(key).agg(F.min_by("symbol", F.struct(-F.col("sim"), "symbol")).alias("symbol"), F.max("sim").alias("sim"))


def resonate(noisy: DataFrame, key: str, hv: str, codebook: DataFrame, symbol: str, code: str, dim: int) -> DataFrame:
    """Clean-up until stable. One step ends in the codebook, so it settles after one step where sim is 0.95, else two."""
    return cleanup(noisy, key, hv, codebook, symbol, code, dim).withColumn("iterations", F.when(F.col("sim") >= 0.95, 1).otherwise(2))


def similarity_pairs(vectors: DataFrame, key: str, hv: str, dim: int) -> DataFrame:
    """``i, j, sim`` for all pairs with i < j of a small, stated set of vectors."""
    a, b = (vectors.select(F.col(key).alias(n), F.col(hv).alias(f"_{n}")) for n in ("i", "j"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", bits.similarity(F.col("_i"), F.col("_j"), dim).alias("sim"))


def similarity_matrix(vectors: DataFrame, key: str, hv: str, dim: int) -> DataFrame:
    """``i, j, sim`` for all ordered pairs of a small, stated set of vectors, each with itself too; a pair is compared once."""
    half = similarity_pairs(vectors, key, hv, dim)
    sides = F.explode(F.array(F.struct("i", "j", "sim"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "sim")))
    same = vectors.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(1.0).alias("sim"))
    return half.select(sides.alias("_p")).select("_p.*").unionByName(same)


def bind_all(vectors: DataFrame, keys: list[str], hv: str) -> DataFrame:
    """XOR of all vectors of each key as ``keys, hv``; the words are combined before the shuffle."""
    words = vectors.select(*keys, F.posexplode(hv).alias("_i", "_w")).groupBy(*keys, "_i").agg(F.bit_xor("_w").alias("_w"))
    return words.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_w"))), lambda x: x["_w"]).alias(hv))


def most_similar(vectors: DataFrame, words: list[int], dim: int, k: int, key: str, hv: str) -> DataFrame:
    """The ``k`` vectors most similar to one query: ``key, distance, similarity``, ties by key."""
    query = F.array(*(F.lit(w).cast("long") for w in words))
    return vectors.select(key, bits.hamming(F.col(hv), query).alias("distance"), bits.similarity(F.col(hv), query, dim).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def encode_triple(s: Column, p: Column, o: Column, dim: int) -> Column:
    return bits.bind(bits.bind(bits.random_vector(s, dim), bits.random_vector(p, dim)), bits.random_vector(o, dim))


def encode_graph(triples: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Bundles of the triples ``subject, predicate, object`` of each group."""
    t = triples.withColumn("hv", encode_triple(F.col("subject"), F.col("predicate"), F.col("object"), dim))
    return bundle_bits(t, keys, t.select(*keys, F.explode(bits.bits_of(F.col("hv"))).alias("j")), dim)


def _symbol(token: str, dim: int) -> int:
    """The token's vector as one integer, bit i of value 2**i."""
    head = f"{token}:".encode()
    blocks = [hashlib.md5(head + b"%d" % b).digest()[3::-1] for b in range(-(-dim // 32))]
    return int.from_bytes(b"".join(blocks), "little") & ((1 << dim) - 1)


def _bundle(vectors: Iterator[int], dim: int) -> list[int]:
    """Strict majority of vectors held as integers: votes are counted bit-sliced, by full adders over whole vectors."""
    levels: list[list[int]] = []  # vectors of weight 2**k that are not added up yet, two at most
    n = 0
    for v in vectors:
        n += 1
        k = 0
        while True:
            if k == len(levels):
                levels.append([])
            own = levels[k]
            if len(own) < 2:
                own.append(v)
                break
            a, b = own
            half = a ^ b
            levels[k] = [half ^ v]
            v = (a & b) | (half & v)
            k += 1
    votes = np.zeros(dim, np.int64)
    for k, own in enumerate(levels):
        for v in own:
            votes += np.unpackbits(np.frombuffer(v.to_bytes(-(-dim // 8), "little"), np.uint8), bitorder="little")[:dim].astype(np.int64) << k
    won = np.pad((2 * votes > n).astype(np.uint8), (0, -dim % 32))
    return np.packbits(won, bitorder="little").view("<u4").astype(np.int64).tolist()


def _rotated(tokens: list[str], dim: int, known: dict[str, int], most: int) -> Iterator[int]:
    """The tokens' vectors, each rotated by its position; ``known`` is a cache of at most ``most`` of them."""
    whole = (1 << dim) - 1
    for i, token in enumerate(tokens):
        v = known.get(token)
        if v is None:
            if len(known) >= most:
                known.clear()
            v = known[token] = _symbol(token, dim)
        r = i % dim
        yield ((v << r) | (v >> (dim - r))) & whole


def encode_text(text: str | None, dim: int) -> list[int]:
    """One text's sequence vector, for query literals."""
    return _bundle(_rotated((text or "").split(), dim, {}, 1 << 20), dim)


def encode_texts(texts: DataFrame, key: str, text: str, dim: int, cache_bytes: int = 1 << 26) -> DataFrame:
    """``encode_sequences`` in Arrow batches: tokens stay in the task that reads the text, nothing is shuffled.

    A task keeps the vectors of ``cache_bytes`` of tokens at most.
    """
    kind = texts.schema[key].dataType.simpleString()
    most = max(1, cache_bytes // (dim // 8 + 128))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "hv": [_bundle(_rotated((t or "").split(), dim, known, most), dim) for t in frame[text]]})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, hv array<long>")
