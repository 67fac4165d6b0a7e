import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash

from memlake.llm.bytetext import chunks, words
from memlake.llm.components import components
from memlake.llm.simhash import links, simhash_groups
from memlake.llm.xxh import xxh64

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(LOW)).split(" ") if w]


def brute(text):
    w = tokens(text)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs):
    up = {a: a for a, _ in pairs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, fa), (b, fb) in itertools.combinations(pairs, 2):
        if (fa ^ fb).bit_count() <= 2:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {a: find(a) for a, _ in pairs}


def test_words_and_hashes():
    texts = ["ab  cd", "", "ef", None, " x\tyy\n", "é A"]
    got = []
    for lo, hi, buf, offs in chunks(pa.array(texts), 5):
        s, e, b = words(buf, offs)
        got += [[bytes(buf[s[i] : e[i]]).decode() for i in range(b[k], b[k + 1])] for k in range(hi - lo)]
    assert got == [["ab", "cd"], [], ["ef"], [], ["x", "yy"], ["é", "A"]]
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 3000, dtype=np.uint8)
    starts = rng.integers(0, 2000, 500)
    ends = starts + rng.integers(0, 400, 500)
    want = [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]
    assert xxh64(buf, starts, ends, 42).tolist() == want


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["Alpha", "beta", "GAMMA", "é", "ñandú", "x" * 300, "delta,", "1", " q"]
    texts = [None, "", " \n", "one", "one two", "ONE  two", "a b c"]
    for _ in range(60):
        base = [rnd.choice(vocab) + str(rnd.randrange(30)) for _ in range(rnd.randrange(1, 600))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "changed"
            texts.append("\n".join(copy))
    rows = [(i * 3 + 1, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(df).collect()}
    fps = [(i, brute(t)) for i, t, _ in rows]
    want = groups(fps)
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in fps}
    assert len(set(want.values())) < len(fps) - 60


def test_links_sparse_dense_and_fine(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    core = rnd.getrandbits(64)
    fps |= {core ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)}
    fps |= {0, 1, (1 << 64) - 1, (1 << 64) - 2, 1 << 63}
    pairs = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in pairs], "fp long, rep long")
    want = groups(pairs)
    for bits, dense in ((4, 16), (4, 3), (2, 16)):
        got = {r.node: r.component for r in components(links(df, bits, dense)).collect()}
        assert {i: got.get(i, i) for i, _ in pairs} == want


def test_components_and_empty(spark):
    chain = [(i + 1, i) for i in range(100)] + [(200, 201), (201, 200), (7, 7), (300, 1000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 300: 300, 1000: 300}
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
