"""Exact top-k inner products by block-at-a-time pruning (operator 8).

Candidates go to the cell of their nearest pivot (a bounded, seeded sample), large cells to several ranges; a range is ordered and
cut into blocks with the greatest and smallest value of every term. For a query, the sum over its terms of the greatest
contribution that a block allows bounds all scores in it. A query first scores its own range, which gives it a kth score; then
its bounds of all blocks are compared with that (tasks hold some thousand blocks' terms and some thousand queries), and it is sent
only to the ranges of blocks that reach it. There it takes the blocks in the order of its bounds, scores each through the block's
forward index (its integer rows) and stops when the next bound is below its kth score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dropped, staged

SCALE = 64
#: Rows of a block and of a range, queries and ranges that are compared at once, and pivots at most.
BLOCK, RANGE, QUERIES, RANGES, PIVOTS = 128, 16_384, 4096, 32, 256


def _coded(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes of 2, 4 or 8 a component, whichever holds them."""
    large = np.abs(x).max(1, initial=0)
    kinds = [(large < 2**15, "<i2"), ((large >= 2**15) & (large < 2**31), "<i4"), (large >= 2**31, "<f8")]
    out = [b""] * len(x)
    for which, kind in kinds:
        for i, row in zip(np.flatnonzero(which).tolist(), x[which].astype(kind), strict=True):
            out[i] = row.tobytes()
    return out


def _decoded(rows: list[bytes], dim: int) -> np.ndarray:
    kinds = {2 * dim: "<i2", 4 * dim: "<i4", 8 * dim: "<f8"}
    if len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), kinds[len(rows[0])]).reshape(len(rows), dim).astype(np.float64)
    return np.array([np.frombuffer(r, kinds[len(r)]) for r in rows], np.float64).reshape(len(rows), dim)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of whole numbers; components that shorter ones lack are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(column.value_lengths())
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    out = np.zeros((len(length), dim))
    out[np.arange(dim)[None, :] < length[:, None]] = flat
    return out


def _place(pivots, dim: int):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            cell = (unit @ pivots.value.T).argmax(1).astype(np.int32) if len(pivots.value) else np.zeros(len(x), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(_coded(x), pa.binary())], ["vec_id", "cell", "row"])

    return run


def _blocks(dim: int):
    """A range's blocks: like rows together, found by halving along the coordinate that varies most."""

    def run(table: pa.Table) -> pa.Table:
        by_id = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        ids, rows = table.column("vec_id").to_numpy()[by_id], _decoded(table.column("row").to_pylist(), dim)[by_id]
        parts, todo = [], [np.arange(len(ids))]
        while todo:
            own = todo.pop()
            if len(own) <= BLOCK:
                parts.append(np.sort(own))
                continue
            x = rows[own]
            side = np.argsort(x[:, x.var(0).argmax()], kind="stable")
            half = -(-len(own) // 2 // BLOCK) * BLOCK
            todo += [own[side[:half]], own[side[half:]]]
        whole = [b"".join(_coded(rows[p])) if len({len(r) for r in _coded(rows[p])}) == 1 else rows[p].astype("<f8").tobytes() for p in parts]
        ends = [(rows[p].max(0).astype("<f8").tobytes(), rows[p].min(0).astype("<f8").tobytes()) for p in parts]
        first = lambda c: pa.array([table.column(c)[0].as_py()] * len(parts), pa.int32())
        return pa.table({"cell": first("cell"), "split": first("split"), "block": pa.array(range(len(parts)), pa.int32()), "ids": pa.array([ids[p].astype("<i8").tobytes() for p in parts], pa.binary()), "rows": pa.array(whole, pa.binary()), "high": pa.array([h for h, _ in ends], pa.binary()), "low": pa.array([w for _, w in ends], pa.binary())})

    return run


_BLOCK_COLUMNS = "cell int, split int, block int, ids binary, rows binary, high binary, low binary"


def _read_blocks(table: pa.Table, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    ids = [np.frombuffer(x, "<i8") for x in table.column("ids").to_pylist()]
    kinds = {2: "<i2", 4: "<i4", 8: "<f8"}
    return [(i, np.frombuffer(r, kinds[len(r) // (len(i) * dim)]).reshape(len(i), dim).astype(np.float64)) for i, r in zip(ids, table.column("rows").to_pylist(), strict=True)]


def _exact(queries: np.ndarray, others: list[np.ndarray]) -> bool:
    """Whether all inner products are exact in doubles."""
    large = max([0.0, *(np.abs(b).max(initial=0) for b in others)]) * np.abs(queries).max(initial=0)
    return large * max(queries.shape[1], 1) < 2.0**53


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` best rows, smaller ids first among equal scores."""
    order = np.lexsort((ids, -scores, q))
    own = q[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < k]


def search(q_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, kth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, candidate ids and scores of the ``k`` best of each query; and how many rows each query scored.

    ``kth`` are scores known to be reached by ``k`` others; what is below them is left out. Sums are exact: whole numbers
    held in doubles, or Python's integers where they could pass 2**53.
    """
    exact = _exact(queries, [b for _, b in blocks])
    kind = np.float64 if exact else object
    to = lambda m: m if exact else np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    queries = to(queries)
    blocks = [(i, to(b)) for i, b in blocks]
    high, low = np.array([b.max(0) for _, b in blocks], kind), np.array([b.min(0) for _, b in blocks], kind)
    positive, negative = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
    bound = positive @ high.T + negative @ low.T
    order = np.argsort(-bound.astype(np.float64), axis=1, kind="stable")
    got_q, got_i, got_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    kth, scored = np.full(len(queries), -np.inf, kind) if kth is None else kth.astype(kind), np.zeros(len(queries), np.int64)
    active = np.arange(len(queries))
    for r in range(len(blocks)):
        if exact:  # a bound that equals the kth score may hide a tie with a smaller id
            active = active[bound[active, order[active, r]] >= kth[active]]
        if not len(active):
            break
        new_q, new_i, new_s = [got_q], [got_i], [got_s]
        at = order[active, r]
        for b in np.unique(at):
            own, (ids, rows) = active[at == b], blocks[b]
            scored[own] += len(rows)
            s = queries[own] @ rows.T
            keep = (s >= kth[own][:, None]) & (ids[None, :] != q_ids[own][:, None])
            i, j = np.nonzero(keep)
            new_q.append(own[i])
            new_i.append(ids[j])
            new_s.append(s[i, j])
        q, i, s = np.concatenate(new_q), np.concatenate(new_i), np.concatenate(new_s)
        top = _best(q, i, s, k)
        got_q, got_i, got_s = q[top], i[top], s[top]
        n = np.bincount(got_q, minlength=len(queries))
        last = np.cumsum(n) - 1
        full = n >= k
        kth[full] = np.maximum(kth[full], got_s[last[full]])
    return got_q, got_i, got_s, scored


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("n_scored", pa.int64())])
_FOUND_COLUMNS = "query_id long, vec_id long, score long, n_scored long"


def _found(ids: np.ndarray, q: np.ndarray, i: np.ndarray, s: np.ndarray, scored: np.ndarray) -> pa.Table:
    """Pairs found, and a row without ``vec_id`` for what each query scored."""
    none = [None] * len(ids)
    return pa.Table.from_arrays([pa.array(np.concatenate([ids[q], ids])), pa.array([*i.tolist(), *none], pa.int64()), pa.array([*(int(v) for v in s), *none], pa.int64()), pa.array(np.concatenate([np.zeros(len(q), np.int64), scored]))], schema=_FOUND)


def _seed(dim: int, k: int):
    """A range's own queries against the range."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked) or not len(blocks):
            return _FOUND.empty_table()
        ids = asked.column("vec_id").to_numpy()
        return _found(ids, *search(ids, _decoded(asked.column("row").to_pylist(), dim), _read_blocks(blocks, dim), k))

    return run


def _reach(dim: int):
    """The queries of a batch that reach some block of each range, other than their own one, by their bounds."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        asked, ends = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        out = []
        if len(asked) and len(ends):
            x, kth = _decoded(asked.column("row").to_pylist(), dim), asked.column("kth").to_numpy()
            high, low = (np.frombuffer(b"".join(ends.column(c).to_pylist()), "<f8").reshape(-1, dim) for c in ("high", "low"))
            place = {n: t.column(c).to_numpy() for n, t, c in (("cell", ends, "cell"), ("split", ends, "split"), ("own", asked, "cell"), ("at", asked, "split"))}
            ranges = sorted(set(zip(place["cell"].tolist(), place["split"].tolist(), strict=True)))
            sure = _exact(x, [high, low])
            bound = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T if sure else np.full((len(x), len(high)), np.inf)
            for cell, split in ranges:
                here = (place["cell"] == cell) & (place["split"] == split)
                go = (bound[:, here] >= kth[:, None]).any(1) & ~((place["own"] == cell) & (place["at"] == split))
                if go.any():
                    own = asked.filter(pa.array(go))
                    out.append({"cell": cell, "split": split, "batch": table.column("batch")[0].as_py(), "asked": pa_bytes(own.select(["vec_id", "row", "kth"]))})
        return pa.Table.from_pylist(out, schema=pa.schema([("cell", pa.int32()), ("split", pa.int32()), ("batch", pa.int64()), ("asked", pa.binary())]))

    return run


def pa_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _visit(dim: int, k: int):
    def run(blocks: pa.Table, routes: pa.Table) -> pa.Table:
        if not len(blocks) or not len(routes):
            return _FOUND.empty_table()
        asked = pa.concat_tables([pa.ipc.open_stream(r).read_all() for r in routes.column("asked").to_pylist()])
        ids = asked.column("vec_id").to_numpy()
        return _found(ids, *search(ids, _decoded(asked.column("row").to_pylist(), dim), _read_blocks(blocks, dim), k, asked.column("kth").to_numpy()))

    return run


def top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score, n_scored``: for rows with an id divisible by ``every`` the ``k`` best others, from rank 1.

    Components are ``floor(64 * x)`` of ``x`` as double; missing ones of shorter vectors are 0. Ties go to the smaller id.
    Null and empty vectors and those with null or non-finite components take no part. A row repeated is searched once as a query
    and counts each time as a candidate. ``n_scored`` tells how many rows were scored for the query: all where no bound fell
    below its kth score. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size("embedding") > 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & good)
    n, dim = v.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    wanted = min(PIVOTS, n // (RANGE // 16))
    near = v.withColumn("h", F.xxhash64(F.lit(7), "vec_id")).where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.lit(2.0 * (wanted + 8) / max(n, 1)))
    sample = _matrix(near.orderBy("h").limit(wanted).select("embedding").toArrow().column(0), dim) if wanted > 1 else np.zeros((0, dim))
    pivots = spark.sparkContext.broadcast(sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300))
    placed = staged(v.mapInArrow(_place(pivots, dim), "vec_id long, cell int, row binary"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(RANGE))).cast("int").alias("splits"))
    ranged = placed.join(F.broadcast(sizes), "cell").withColumn("split", F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int")).drop("splits")  # one row a pivot
    blocks = staged(ranged.groupBy("cell", "split").applyInArrow(_blocks(dim), _BLOCK_COLUMNS), "blocks")
    asked = staged(ranged.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "asked")
    seeds = staged(blocks.groupBy("cell", "split").cogroup(asked.groupBy("cell", "split")).applyInArrow(_seed(dim, k), _FOUND_COLUMNS), "seeds")
    kth = seeds.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("kth"))
    batches = max(1, -(-n // every // QUERIES))
    known = asked.join(kth, asked.vec_id == kth.query_id).select(F.pmod(F.xxhash64("vec_id"), F.lit(batches)).alias("batch"), "cell", "split", "vec_id", "row", "kth")
    groups = max(1, -(-n // (RANGE * RANGES)))
    each_group, each_batch = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long"))) for x in (groups, batches))
    queries = known.select(each_group.alias("g"), "batch", "cell", "split", "vec_id", "row", "kth", F.lit(None).cast("binary").alias("high"), F.lit(None).cast("binary").alias("low"), F.lit(True).alias("is_query"))
    ends = blocks.select(F.pmod(F.xxhash64("cell", "split"), F.lit(groups)).alias("g"), each_batch.alias("batch"), "cell", "split", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("binary").alias("row"), F.lit(None).cast("double").alias("kth"), "high", "low", F.lit(False).alias("is_query"))
    routes = staged(queries.union(ends).groupBy("g", "batch").applyInArrow(_reach(dim), "cell int, split int, batch long, asked binary"), "routes")
    visited = blocks.join(routes.select("cell", "split", "batch"), ["cell", "split"])
    going = routes.select(F.col("cell").alias("c"), F.col("split").alias("s"), F.col("batch").alias("b"), "asked")
    found = visited.groupBy("cell", "split", "batch").cogroup(going.groupBy("c", "s", "b")).applyInArrow(_visit(dim, k), _FOUND_COLUMNS)
    dropped(placed)
    own = Window.partitionBy("query_id")
    both = seeds.union(found).withColumn("n_scored", F.sum("n_scored").over(own)).where("vec_id is not null")
    return both.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).select("query_id", "rank", "vec_id", "score", "n_scored").where(F.col("rank") <= k)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others for every ``embeddings`` row whose id is divisible by 20, by ``top_k``."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("n_scored")
