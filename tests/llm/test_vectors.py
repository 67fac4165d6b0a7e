import math

import numpy as np

from memlake.llm.topk import search, top_k
from memlake.llm.vectorlinks import recall, vector_groups

SCHEMA = "vec_id long, embedding array<float>, label int, rep long"


def rows_of(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    core = rng.normal(size=16)
    x[:200] = core + 0.12 * rng.normal(size=(200, 16))
    x[200:230] = x[200]
    x[230:300] = x[300:370] + 0.02 * rng.normal(size=(70, 16))
    rows = [(i * 2, [float(v) for v in x[i].astype(np.float32)], int(i % 3) if i >= 200 else 0, 7) for i in range(n)]
    odd = [(5001, None, 1), (5003, [0.0] * 16, 1), (5005, [1.0, None] + [0.0] * 14, 1), (5007, [float("nan")] * 16, 1), (5009, [float("inf")] + [1.0] * 15, 1), (5020, rows[0][1], None), (5011, [1.0, 2.0], 1), (5013, [1.0, 2.0], 1), (5040, [], 1)]
    return rows + [(*r, 7) for r in odd]


def brute_links(rows, cosine=0.98):
    ok = [r for r in rows if r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    ids = {r[0]: [0, r[0]] for r in rows}
    up = {r[0]: r[0] for r in rows}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for key in {(r[2], len(r[1])) for r in ok}:
        part = [r for r in ok if (r[2], len(r[1])) == key]
        m = np.array([r[1] for r in part], float)
        m /= np.linalg.norm(m, axis=1)[:, None]
        for i, j in zip(*np.nonzero(np.triu(m @ m.T >= cosine, 1)), strict=True):
            a, b = part[i][0], part[j][0]
            ids[a][0] += 1
            ids[b][0] += 1
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: (n, find(i)) for i, (n, _) in ids.items()}


def test_links(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute_links(rows)
    for r in vector_groups(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (*want.pop(r.vec_id), r.vec_id == r.component_id)
    assert not want
    assert recall(df) >= 0.95


def test_links_across_shards_and_blocks(spark, monkeypatch):
    import memlake.llm.vectorlinks as m

    monkeypatch.setattr(m, "SHARD", 40)
    monkeypatch.setattr(m, "BLOCK", 64)
    rows = rows_of(600, 3)
    want = brute_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in m.vector_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert m.vector_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_separated_pivots():
    from memlake.llm.vectorlinks import _unit, separated

    x = _unit(np.random.default_rng(4).normal(size=(700, 6)))
    kept = separated(x, 700, 0.9)
    assert 1 < len(kept) < 700 and np.array_equal(kept[0], x[0])
    assert ((kept @ kept.T)[~np.eye(len(kept), dtype=bool)] < 0.9).all() and ((x @ kept.T).max(1) >= 0.9).all()
    assert len(separated(x, 5, 0.9)) == 5 and len(separated(x[:0], 5, 0.9)) == 0


def test_large_group_of_near_copies_keeps_its_links(spark, monkeypatch):
    """A third of all rows are different near-copies of one vector, far more than a shard or a block."""
    import memlake.llm.vectorlinks as m

    monkeypatch.setattr(m, "SHARD", 25)
    monkeypatch.setattr(m, "BLOCK", 96)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(750, 16))
    x[:250] = rng.normal(size=16) + 0.05 * rng.normal(size=(250, 16))
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], 1, 7) for i in range(len(x))]
    want = brute_links(rows)
    assert sum(n for n, _ in want.values()) >= 50_000
    got = {r.vec_id: (r.n_links, r.component_id) for r in m.vector_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def brute_top(rows, k=20):
    ok = [(r[0], [math.floor(64 * v) for v in r[1]]) for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def top_rows(df):
    return sorted(map(tuple, df.drop("n_scored").collect()))


def test_top_k(spark, monkeypatch):
    import memlake.llm.topk as m

    rows = rows_of(700, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_top(rows)
    assert top_rows(top_k(df)) == want
    monkeypatch.setattr(m, "RANGE", 150)
    monkeypatch.setattr(m, "QUERIES", 9)
    monkeypatch.setattr(m, "RANGES", 1)
    assert top_rows(m.top_k(df)) == want
    huge = [(20, [1e6, 3.0], 1, 1), (40, [1e6, 2.0], 1, 1), (41, [-1e6, 0.0], 1, 1)]
    assert top_rows(m.top_k(spark.createDataFrame(huge, SCHEMA))) == brute_top(huge)
    assert m.top_k(df.limit(0)).collect() == []


def test_blocks_are_pruned():
    rng = np.random.default_rng(2)
    blocks = [(np.arange(64) + 64 * b, np.floor(64 * (3 * np.eye(8)[b % 8] + 0.1 * rng.normal(size=(64, 8))))) for b in range(16)]
    queries = np.floor(64 * np.eye(8))
    _, _, _, scored = search(np.full(8, -1), queries, blocks, 10)
    assert scored.sum() <= 8 * 3 * 64


def test_clustered_vectors_are_pruned(spark, monkeypatch):
    """Sixty directions of 64 dimensions: most ranges and blocks are never scored, and the result is whole."""
    import memlake.llm.topk as m

    monkeypatch.setattr(m, "RANGE", 256)
    monkeypatch.setattr(m, "QUERIES", 40)
    monkeypatch.setattr(m, "BLOCK", 32)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 64))[rng.integers(0, 60, 3000)] + 0.05 * rng.normal(size=(3000, 64))
    rows = [(i, [float(v) for v in x[i]], 1, 1) for i in range(len(x))]
    got = m.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows)
    assert sum({r.query_id: r.n_scored for r in got}.values()) < 0.5 * 150 * 3000
