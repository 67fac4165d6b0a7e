import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from memlake.llm import mixing, packing
from memlake.llm.bytetext import mixed, word_keys
from memlake.llm.mixing import fit_budget, mix
from memlake.llm.packing import best_fit_decreasing, lower_bound, pack, pack_documents, pieces, tokenizer_path
from tests.llm.test_ppm import thue_morse
from tests.llm.test_simhash import tokens


def reference(text):
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [None, "", " \n", "Hello, World's 12 <|endoftext|>", "été İstanbul ΣΑΣ 東京　x é ́q don't've 's", "it's o'clock a'b'''s" + "\x1c\x85", "w" * 9000, " ".join(f"Word{i}, {i * 7}" for i in range(9000))]


def test_ids_are_the_tokenizers_own(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS + TEXTS[3:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = defaultdict(list)
    for r in pieces(df, tokenizer_path(), with_ids=True).orderBy("doc_id", "piece").collect():
        assert r.start == 4096 * r.piece == len(got[r.doc_id]) and r.length == len(r.ids) <= 4096
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
    assert dict(got) == {i: reference(t) for i, t, _ in rows}


def test_words_with_marks_and_odd_characters_keep_their_ids():
    rnd, encoder = random.Random(5), packing.WordEncoder(tokenizer_path())
    own = Tokenizer.from_file(tokenizer_path())
    own.encode_special_tokens = True
    alphabet = ["a", "B", "'s", "9", packing.MARK, "\u0301", "\u00a0", "\u3000", "\u03a3", "\u0130", "<|endoftext|>", "\U0001f600", "\u4e2d", "-", "\x1c"]
    for marks in (False, True):
        letters = [x for x in alphabet if marks or x != packing.MARK]
        for _ in range(4):  # new words beside known ones
            texts = [" ".join("".join(rnd.choices(letters, k=rnd.randint(1, 6))) for _ in range(rnd.randint(0, 300))) for _ in range(20)]
            data = [t.encode() for t in texts]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
            flat, bounds = encoder.encode(np.frombuffer(b"".join(data), np.uint8), offs)
            for i, t in enumerate(texts):
                assert flat[bounds[i] : bounds[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids
    assert (np.diff(encoder.mix.view(np.int64) ^ np.int64(-(2**63))) > 0).all()


def test_words_of_like_hash_keep_their_own_ids(spark, monkeypatch):
    t, f = thue_morse(1024)
    rows = [(0, f"{t} {f} {t}"), (1, f), (2, " ".join(thue_morse(8192))), (3, "abcdefghijklmnop abcdefghijklmnoq abcdefghijklmno abcdefgh abcdefghi a"), *((i, " ".join(f"Wörd{i * j} {'x' * j}" for j in range(40))) for i in range(4, 20))]
    ids = lambda r: list(encoder.encode(np.frombuffer(r.encode(), np.uint8), np.array([0, len(r.encode())]))[0])
    for few in (False, True):
        if few:  # nearly all words collide
            monkeypatch.setattr(packing, "mixed", lambda lo, hi: mixed(lo, hi) & np.uint64(3))
            monkeypatch.setattr(packing, "word_keys", lambda *a: tuple(np.where(k >> np.uint64(56) == 255, np.uint64(255 << 56), k) for k in word_keys(*a)))
        encoder = packing.WordEncoder(tokenizer_path())
        for _ in range(2):
            for _, r in rows:
                assert [*ids(r), 1] == reference(r)


def check(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    got = pack_documents(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string")).collect()
    assert len(got) == 3 * sum(-(-len(reference(t)) // 4096) for t in TEXTS)
    check(got, 4096)
    rnd = random.Random(2)
    lengths = [min(4096, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    df = spark.createDataFrame([(i % 900, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = pack(df, partition_pieces=300).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert check(rows, 4096) <= lower_bound(np.array(lengths), 4096) + 1
    assert pack(df.limit(0)).collect() == []


def test_bound_and_best_fit():
    assert lower_bound(np.array([6, 6, 6]), 10) == 3 and lower_bound(np.array([5, 5, 5]), 10) == 2
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(1, 21, 60)
        b, o, fill = best_fit_decreasing(x, 20)
        assert fill.max() <= 20 and np.bincount(b, x).tolist() == fill.tolist()
        assert lower_bound(x, 20) <= len(fill) <= lower_bound(x, 20) * 11 // 9 + 1


def brute_targets(total):
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    t, left, open_ = {}, float(sum(total.values())), set(names)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            return t | share
        for s in over:
            t[s] = 3.0 * total[s]
            left -= t[s]
            open_.discard(s)


def test_mixing(spark):
    rnd = random.Random(4)
    names = ["b", "B", None, "é", "a", "", "\U0001f600", "￮"]
    rows = [(i, " ".join("x" * rnd.randrange(1, 4) for _ in range(rnd.choice([0, 1, 3, 3, 3, rnd.randrange(400)]))), rnd.choice(names[: rnd.choice([1, 3, 8])])) for i in range(3000)]
    rows += [(9000 + i, "same words here", "b") for i in range(2500)] + [(1, None, None), (9000, "same words here", "b")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = mix(df).drop("row").collect()
    total, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        total[s] += len(tokens(t))
    want = brute_targets(total)
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken in {r.size * c for c in range(4)} and r.source_size == total[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in total:
        assert abs(taken[s] - want[s]) <= max(3, 0.001 * want[s]), s
    again = mix(df.repartition(7)).drop("row").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix(df.limit(0)).collect() == []
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()] == [0, 0]


def best_sum(sizes, counts, budget):
    sums = {0}
    for s, n in zip(sizes, counts, strict=True):
        sums = {x + s * k for x in sums for k in range(n + 1) if x + s * k <= budget}
    return max(sums)


def test_fit_budget_exact():
    rng = np.random.default_rng(3)
    for copies in (1, 2, 3):
        for most in (30, 3000, 2_000_000):
            for _ in range(6):
                sizes, counts = np.unique(rng.integers(1, most, 5), return_counts=True)
                counts = counts * rng.integers(1, 3, len(counts))
                b = int((sizes * counts).sum() * copies * rng.random())
                k = fit_budget(sizes, counts, b, copies)
                assert (k >= 0).all() and (k <= copies * counts).all()
                assert (k * sizes).sum() == best_sum(sizes.tolist(), (copies * counts).tolist(), b)
        sizes, counts = np.unique(rng.integers(1, 100_000, 3000), return_counts=True)
        b = int((sizes * counts).sum() * rng.random())
        assert (fit_budget(sizes, counts, b, copies) * sizes).sum() == b
    assert fit_budget(np.array([1_000_000, 100_000]), np.array([1, 5]), 900_000, 3).tolist() == [0, 9]
    assert fit_budget(np.array([0, 7]), np.array([5, 2]), 100).tolist() == [0, 2]
    assert fit_budget(np.array([], int), np.array([], int), 9).tolist() == []


def test_lengths_of_many_documents_mix_alike(spark, monkeypatch):
    rows = [(i, "w " * (1 if i % 3 else 2 + i % 40), [None, "a", "b", "c"][min(i % 7, 3)]) for i in range(900)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = lambda: sorted((r.doc_id, r.taken, r.source_size, round(r.target, 6)) for r in mix(df).collect())
    want = told()
    for hot in (1, 5):  # all lengths, and some of them
        monkeypatch.setattr(mixing, "HOT_ROWS", hot)
        assert told() == want and len(want) == 930
