"""Embedding near-duplicates over robust-pruned flat graphs (operator 6).

Equal vectors are one class. Class representatives are put into the overlapping shards of their nearest
pivots, a bounded, seeded sample of the vectors whose members are no near-duplicates of one another, so a group
of near-copies stays together. A shard too large for one task is dealt to blocks, and tasks
take pairs of blocks. A task builds a flat graph over a block: small overlapping clusters, robust
pruning in each, adjacency lists united. From the clusters' medoids all queries search greedily at once;
what lies within range is expanded as long as it leads to more. Each task audits its recall on some queries
by brute force and searches wider until it is high. A vector asks in the
shard of its nearest pivot. All pairs found are verified in double precision; a pair that both ends find in
different shards counts in the lower one only. A second audit compares the links of a bounded sample of queries
with brute force over all vectors; while too few are found, vectors go to twice as many shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import staged

COSINE = 0.98
SHARD = 1024
BLOCK = 4096
OVERLAP = 3
MOST_PIVOTS = 16384
DEGREE, BEAM, CLUSTER, AUDIT = 12, 8, 128, 48
#: Queries searched at once, beam entries that one step expands, and what single precision may be wrong by.
AT_ONCE, STEP, SLACK = 512, 4, 1e-5
#: Queries of the audit against all vectors, and the recall below which shards overlap more.
AUDITED, LEAST_RECALL = 256, 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_prune(own_rows: np.ndarray, x: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = 1.2) -> np.ndarray:
    """For rows ``own_rows`` of ``x`` at most ``degree`` of their candidates ``near`` (-1: none), nearest first, skipping those nearer to one kept."""
    n, rows, picked = len(own_rows), x[own_rows], x[near]
    own = 2 - 2 * np.einsum("nd,ncd->nc", rows, picked)
    own[near == own_rows[:, None]] = np.inf
    between = 2 - 2 * picked @ picked.transpose(0, 2, 1)
    kept, at, alive = np.full((n, degree), -1), np.arange(n), own.copy()
    for k in range(degree):
        best = alive.argmin(1)
        ok = np.isfinite(alive[at, best])
        if not ok.any():
            break
        kept[ok, k] = near[at, best][ok]
        alive[alpha * np.maximum(between[at, best], 0) <= own] = np.inf
        alive[at, best] = np.inf
    return kept


def build_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The united adjacency lists of unit vectors ``x`` (starts, then neighbours) and the medoids of its clusters."""
    n, rng = len(x), np.random.default_rng(seed)
    k = max(1, n // CLUSTER)
    centre = x[rng.choice(n, k, replace=False)]
    two = np.argsort(-(x @ centre.T), axis=1)[:, :2]
    medoids, edges = [], []
    for c in range(k):
        part = np.flatnonzero((two == c).any(1))
        if not len(part):
            continue
        y = x[part]
        medoids.append(part[(y @ y.sum(0)).argmax()])
        width = min(len(part), 2 * DEGREE)
        for lo in range(0, len(part), 256):
            own = np.arange(lo, min(lo + 256, len(part)))
            near = np.argpartition(-(y[own] @ y.T), width - 1, axis=1)[:, :width]
            far = rng.integers(0, len(part), (len(own), 4))  # a few long links keep the graph connected
            kept = robust_prune(own, y, np.hstack([near, far]))
            rows, _ = np.nonzero(kept >= 0)
            edges.append(part[lo + rows] * n + part[kept[kept >= 0]])
    m = np.array(medoids)
    edges.append((m[:, None] * n + m[None, :]).ravel())
    one = np.concatenate(edges)
    both = np.unique(np.concatenate([one, one % n * n + one // n]))
    both = both[both // n != both % n]
    return np.searchsorted(both // n, np.arange(n + 1)), both % n, m


def _neighbours(starts: np.ndarray, to: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``nodes``, neighbour) of all neighbours."""
    count = starts[nodes + 1] - starts[nodes]
    owner = np.repeat(np.arange(len(nodes)), count)
    return owner, to[starts[nodes][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)]


def search(queries: np.ndarray, x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], medoids: np.ndarray, cosine: float, beam: int) -> np.ndarray:
    """Boolean (query, row): rows found within range by greedy search from the medoids, expanded over the range."""
    nq, n = len(queries), len(x)
    seen, found, mark = np.zeros(nq * n, bool), np.zeros(nq * n, bool), np.zeros(nq * n, bool)
    beam_row, beam_sim, done = np.zeros((nq, beam), np.int64), np.full((nq, beam), -np.inf, x.dtype), np.zeros((nq, beam), bool)

    def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys (query * n + row) not seen before, once each, and their similarities."""
        mark[keys] = True
        keys = np.flatnonzero(mark & ~seen)
        mark[:] = False
        seen[keys] = True
        sim = np.empty(len(keys), x.dtype)
        for lo in range(0, len(keys), 65_536):
            q, r = np.divmod(keys[lo : lo + 65_536], n)
            sim[lo : lo + 65_536] = np.einsum("nd,nd->n", queries[q], x[r])
        found[keys[sim >= cosine - SLACK]] = True
        return keys, sim

    keys, sim = look((np.arange(nq)[:, None] * n + medoids[None, :]).ravel())
    while True:
        # the best of the beam and of what is new
        q = keys // n
        count = np.bincount(q, minlength=nq)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
        new_row, new_sim = np.zeros((nq, count.max(initial=0)), np.int64), np.full((nq, count.max(initial=0)), -np.inf, x.dtype)
        new_row[q, place], new_sim[q, place] = keys % n, sim
        row, sim, old = np.hstack([beam_row, new_row]), np.hstack([beam_sim, new_sim]), np.hstack([done, np.zeros(new_row.shape, bool)])
        best = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
        beam_row, beam_sim, done = (np.take_along_axis(v, best, 1) for v in (row, sim, old))
        open_ = np.where(done, -np.inf, beam_sim)
        step = min(STEP, beam)
        pick = np.argpartition(-open_, step - 1, axis=1)[:, :step]
        ok = np.isfinite(np.take_along_axis(open_, pick, 1))
        if not ok.any():
            break
        q, k = np.nonzero(ok)
        done[q, pick[q, k]] = True
        owner, near = _neighbours(*graph, beam_row[q, pick[q, k]])
        keys, sim = look(q[owner] * n + near)
    front = np.flatnonzero(found)
    while len(front):
        for lo in range(0, len(front), 65_536):
            owner, near = _neighbours(*graph, front[lo : lo + 65_536] % n)
            mark[front[lo : lo + 65_536][owner] // n * n + near] = True
        keys, sim = look(np.flatnonzero(mark))
        front = keys[sim >= cosine - SLACK]
    return found.reshape(nq, n)


def find_in_block(queries: np.ndarray, x: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of the pairs of unit vectors in range, verified in double precision, some queries at a time."""
    fast, asked = x.astype(np.float32), queries.astype(np.float32)
    starts, to, medoids = build_graph(fast)
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    truth = queries[sample] @ x.T >= cosine
    beam = min(BEAM, len(x))
    while (search(asked[sample], fast, (starts, to), medoids, cosine, beam) & truth).sum() < 0.98 * truth.sum() and beam < len(x):
        beam = min(4 * beam, len(x))
    for lo in range(0, len(queries), AT_ONCE):
        own = queries[lo : lo + AT_ONCE]
        found = search(asked[lo : lo + AT_ONCE], fast, (starts, to), medoids, cosine, beam)
        if found.sum() > found.size // 16:
            q, r = np.nonzero(found & (own @ x.T >= cosine))
        else:
            q, r = np.nonzero(found)
            sure = np.concatenate([np.einsum("nd,nd->n", own[q[k : k + 65_536]], x[r[k : k + 65_536]]) >= cosine for k in range(0, len(q), 65_536)] or [np.zeros(0, bool)])
            q, r = q[sure], r[sure]
        yield lo + q, r


def separated(x: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """Of unit vectors ``x``, in order, those less similar than ``cosine`` to all taken before; ``most`` at most."""
    kept = x[:0]
    for lo in range(0, len(x), 512):
        y = x[lo : lo + 512]
        if len(kept):
            y = y[(y @ kept.T).max(1) < cosine]
        sims, free = y @ y.T, np.ones(len(y), bool)
        for i in range(len(y)):
            if free[i]:
                free[i + 1 :] &= sims[i, i + 1 :] < cosine
        kept = np.vstack([kept, y[free]])
        if len(kept) >= most:
            break
    return kept[:most]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), "<f8")
    return data.reshape(len(column), -1)


_LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _task(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        side = table.column("side").to_numpy()
        same = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
        shard = table.column("shard")[0].as_py()
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        raw, shards = _unit(_vectors(table.column("vector"))), np.array(table.column("shards").to_pylist()).reshape(len(rep), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        if not len(a) or not len(b):
            return _LINKS.empty_table()
        linked = np.zeros((len(a), len(b)), bool)
        for ask, rows, table_of in ((a, b, linked),) if same else ((a, b, linked), (b, a, linked.T)):
            home = np.flatnonzero(shards[ask, 0] == shard)  # each vector asks in the shard of its nearest pivot
            if not len(home):
                continue
            for q, r in find_in_block(raw[ask[home]], raw[rows], cosine):
                other = shards[rows[r], 0]
                twice = (shards[ask[home[q]]] == other[:, None]).any(1) & (other < shard)  # the other end finds the pair, too
                table_of[home[q[~twice]], r[~twice]] = True
        if same:
            linked |= linked.T
            np.fill_diagonal(linked, False)
        links, root, mark = np.zeros(len(rep), np.int64), np.arange(len(rep)), np.zeros(len(rep), bool)
        for lo in range(0, len(a), AT_ONCE):
            part = linked[lo : lo + AT_ONCE].astype(np.float64)
            links[a[lo : lo + AT_ONCE]] += (part @ copies[b]).astype(np.int64)
            if not same:
                links[b] += (copies[a[lo : lo + AT_ONCE]] @ part).astype(np.int64)
        for q in np.flatnonzero(linked.any(1)):
            groups = root[b[linked[q]]]
            low, high = min(groups.min(), root[a[q]]), max(groups.max(), root[a[q]])
            if low < high:  # rows are sorted by rep: the lowest root is the smallest one
                mark[groups] = mark[root[a[q]]] = True
                root[mark[root]] = low
                mark[:] = False
        hit = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(rep[hit]), pa.array(links[hit]), pa.array(rep[root[hit]])], schema=_LINKS)

    return run


def _batches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, vectors) of a column of lists of doubles, for each length of vector."""
    length = np.asarray(column.value_lengths())
    starts, flat = np.asarray(column.offsets)[:-1], np.asarray(column.values)
    for dim in np.unique(length).tolist():
        at = np.flatnonzero(length == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)[None, :]]


def _assign(pivots, overlap: int):
    """The nearest pivots of the vector's dimension, nearest first, at most ``overlap``; vectors as bytes of doubles."""

    def run(batches):
        for batch in batches:
            dims, data, shards = np.zeros(batch.num_rows, np.int32), [b""] * batch.num_rows, [[0]] * batch.num_rows
            for at, vectors in _batches(batch.column(2)):
                dims[at] = vectors.shape[1]
                own = pivots.value.get(vectors.shape[1], np.zeros((0, 1)))
                wide = min(overlap, len(own))
                for lo in range(0, len(at), 256):
                    if wide:
                        sims = -(_unit(vectors[lo : lo + 256]) @ own.T)
                        top = np.argpartition(sims, wide - 1, axis=1)[:, :wide]
                        top = np.take_along_axis(top, np.take_along_axis(sims, top, 1).argsort(1, kind="stable"), 1)
                    for k, i in enumerate(at[lo : lo + 256].tolist()):
                        data[i] = vectors[lo + k].tobytes()
                        shards[i] = top[k].tolist() if wide else [0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(data, pa.binary()), batch.column(3), pa.array(shards, pa.list_(pa.int64()))], ["rep", "label", "dim", "vector", "copies", "shards"])

    return run


def _count_links(queries, cosine: float):
    """Links that the audited ``queries`` (by label and dimension: ids and unit vectors) have in the batch."""

    def run(batches):
        for batch in batches:
            label, rep, copies = np.array(batch.column(1).to_pylist(), object), batch.column(0).to_numpy(), batch.column(3).to_numpy()
            found: dict[int, int] = {}
            for at, vectors in _batches(batch.column(2)):
                for key in {(v, vectors.shape[1]) for v in label[at].tolist()} & queries.value.keys():
                    ids, asked = queries.value[key]
                    own = at[label[at] == key[0]]
                    near = (asked @ _unit(vectors[label[at] == key[0]]).T >= cosine) & (ids[:, None] != rep[own][None, :])
                    for i, n in zip(ids.tolist(), (near @ copies[own]).tolist(), strict=True):
                        found[i] = found.get(i, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["rep", "there"])

    return run


def _hashed(classes: DataFrame, seed: int, most: int, total: int) -> list:
    """A seeded sample of at most ``most`` classes."""
    near = classes.select("rep", "label", "embedding", F.xxhash64(F.lit(seed), "rep", "label").alias("h"))
    return near.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.lit(2.0 * (most + 8) / max(total, 1))).orderBy("h").limit(most).collect()


def audit(classes: DataFrame, found: DataFrame, total: int, cosine: float) -> float:
    """Recall of ``found`` for a bounded, seeded sample of queries, against brute force over all ``classes``."""
    queries: dict = {}
    for r in _hashed(classes, 11, AUDITED, total):
        queries.setdefault((r.label, len(r.embedding)), []).append((r.rep, r.embedding))
    asked = classes.sparkSession.sparkContext.broadcast({k: (np.array([i for i, _ in v]), _unit(np.array([x for _, x in v]))) for k, v in queries.items()})
    there = classes.select("rep", "label", "embedding", "copies").mapInArrow(_count_links(asked, cosine), "rep long, there long").groupBy("rep").agg(F.sum("there").alias("there"))
    got = found.groupBy("rep").agg(F.sum("links").alias("links")).join(F.broadcast(there), "rep", "right")
    hits, there = got.agg(F.sum(F.least(F.coalesce("links", F.lit(0)), "there")), F.sum("there")).first()
    return hits / there if there else 1.0


def link_classes(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame, float]:
    """Members ``vec_id, rep, copies`` of the classes of equal vectors, links ``rep, links, root`` of classes, and the audited recall."""
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.col("label").cast("string").alias("label")).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    v = v.withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))  # -0.0 and 0.0 are equal
    classes = staged(v.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    members = v.join(classes, ["label", "embedding"]).select("vec_id", "label", "rep", "copies")
    most, total = (x or 0 for x in classes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first())
    wanted = min(MOST_PIVOTS, -(-most // SHARD))
    sample: dict[int, list] = {}
    if wanted > OVERLAP:  # fewer shards would all hold nearly all vectors
        for r in _hashed(classes, 7, 2 * wanted, total):
            sample.setdefault(len(r.embedding), []).append(r.embedding)
    apart = float(np.cos(1.5 * np.arccos(np.clip(cosine, -1, 1))))
    pivots = {d: separated(_unit(np.array(p, np.float64)), wanted, apart) for d, p in sample.items()}
    overlap = OVERLAP
    while True:
        found = _links(classes, spark.sparkContext.broadcast({d: p if len(p) > overlap else p[:1] for d, p in pivots.items()}), overlap, cosine)
        share = audit(classes, found, total, cosine)
        if share >= LEAST_RECALL or overlap >= max((len(p) for p in pivots.values()), default=0):
            return members, found, share
        overlap *= 2


def _links(classes: DataFrame, pivots, overlap: int, cosine: float) -> DataFrame:
    placed = staged(classes.select("rep", "label", "embedding", "copies").mapInArrow(_assign(pivots, overlap), "rep long, label string, dim int, vector binary, copies long, shards array<long>"), "placed")
    each = placed.withColumn("shard", F.explode("shards"))
    sizes = each.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    each = each.join(sizes, ["label", "dim", "shard"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # the pairs of blocks that hold this row: as the lower block (side 0) or as the upper one (side 1)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("b"), k).alias("bi"), F.greatest(F.col("b"), k).alias("bj"), (F.col("b") > k).cast("int").alias("side")))
    tasks = each.withColumn("p", F.explode(pairs)).select("label", "dim", "shard", "p.bi", "p.bj", "p.side", "rep", "copies", "vector", "shards")
    return staged(tasks.groupBy("label", "dim", "shard", "bi", "bj").applyInArrow(_task(cosine), "rep long, links long, root long"), "links")


def vector_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors`` (``vec_id, embedding, label``): ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and their cosine is ``cosine`` or more. Vectors with null label, that are
    null, empty, zero or have null or non-finite components, and vectors of different length, link with nothing. Equal vectors always link;
    repeated rows count as others; an empty table gives no rows; other columns are not read.
    """
    members, found, _ = link_classes(vectors, cosine)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    known = members.join(links, "rep", "left").join(groups, members.rep == groups.node, "left")
    known = known.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    one = known.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(one, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def recall(vectors: DataFrame, cosine: float = COSINE) -> float:
    """The audited recall: links of a bounded sample of queries, against brute force over all vectors."""
    return link_classes(vectors, cosine)[2]


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every row of ``embeddings``, by ``vector_groups``."""
    return vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
