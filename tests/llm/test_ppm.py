import math
import random
import zlib
from collections import Counter

import pytest

from memlake.llm.ppm import ppm_scores
from tests.llm.test_simhash import LOW, tokens


def brute_trie(train, order):
    seen = {}
    for t in train:
        s = b"\xff" * order + t + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen.setdefault(s[i - k : i], Counter())[s[i]] += 1
    return seen


def brute_ppm(seen, text, order):
    """PPM with method D escapes and exclusion, straight from its definition."""
    s, total = b"\xff" * order + text + b"\xff", 0.0
    for i in range(order, len(s)):
        ruled = set()
        for k in range(order, -1, -1):
            at = {b: c for b, c in seen.get(s[i - k : i], {}).items() if b not in ruled}
            if not at:
                continue
            n, d = sum(at.values()), len(at)
            if s[i] in at:
                total += math.log10((2 * at[s[i]] - 1) / (2 * n))
                break
            total += math.log10(d / (2 * n))
            ruled |= set(at)
        else:
            total -= math.log10(257 - len(ruled))
    return total


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s, s.translate({97: 98, 98: 97})


@pytest.mark.parametrize("order, shard_text", [(5, 1 << 23), (7, 1 << 12)])
def test_against_brute_force(spark, order, shard_text):
    rnd = random.Random(1)
    vocab = ["the", "of", "Und", "naïve", "x1", "zz", "abc", "q"]
    texts = [None, "", "  ", "The the THE", "unseen ☃ bytes"] + [" ".join(rnd.choice(vocab) + rnd.choice(["", "", "s", str(rnd.randrange(50))]) for _ in range(rnd.randrange(1, 80))) for _ in range(120)]
    texts += ["w" * 3000, texts[20], texts[20], *thue_morse(1024), thue_morse(2048)[1], " ".join(thue_morse(4096)), "a" * 9_000]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in ppm_scores(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3), order=order, shard_text=shard_text).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows}
    low = {i: (t or "").translate(LOW) for i, t, _ in rows}
    words = {i: [*tokens(t), None] for i, t, _ in rows}
    c = Counter(w for i in words if not out[i] for w in words[i])
    n = sum(c.values())
    trie = brute_trie([low[i].encode() for i in low if not out[i]], order)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(words[i]), sum(c[w] > 0 for w in words[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in words[i]), rel_tol=1e-9)
        assert math.isclose(r.score, brute_ppm(trie, low[i].encode(), order), abs_tol=2**-21 * (len(low[i].encode()) + 1)), i


def test_empty_and_repeated(spark):
    assert ppm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    twice = ppm_scores(spark.createDataFrame([(3, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert len(twice) == 3 and twice[0].score < 0


def test_scores_do_not_depend_on_chunks(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["aa", "ab", "ba", "Ünd", "c"]) for _ in range(rnd.randrange(40))) for _ in range(60)] + [None, "", "aa ab", "aa ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    one = {r.doc_id: r for r in ppm_scores(docs).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = ppm_scores(docs, chunk_text=1).collect()  # a chunk a batch
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(many) == len(texts)
    for r in many:
        o = one[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (o.held_out, o.n_tokens, o.n_known, o.train_tokens)
        assert r.score == o.score and math.isclose(r.base_score, o.base_score, rel_tol=1e-9)
