import zlib

import numpy as np

from memlake.llm.htmltext import extract, main_text, weights
from memlake.llm.langid import SCALE, Regression, identify

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site name</header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First   para\n with <b>bold</b>text &eacute;&nbsp;x.<br><p>Second &lt;p&gt; &amp para<aside>Side</aside></p><ul><li>item one</li><li>item two</ul>
<form><input>Sign up</form></article><section class="comments"><p>Reader says hi hi hi hi hi hi</p></section><footer>&copy; 2020</footer></body></html>"""
TEXT = "Head & line\nFirst para with boldtext é x.\nSecond <p> & para\nitem one\nitem two"
PLAIN = "<html><body><ul><li><a>x</a></li><li><a>y</a></li></ul><div class='sidebar'><p>no no</p></div><div><p>A long main paragraph of many words stands here.</p><p>And another one follows it.</p></div><div class=footer>foot</div></body></html>"


def test_extract(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "", "", 1), (4, "v", PLAIN, 1), (5, "w", "just words & more", 1), (6, "z", "<p <<>> <b x='", 1), (7, "n", "<nav>a</nav>", 1), (1, "u", PAGE, 1), (8, "l", "<article>" + "<p>word " * 30000 + "</article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert by[1] == TEXT and by[2] == by[3] == by[7] == ""
    assert by[4] == "A long main paragraph of many words stands here.\nAnd another one follows it."
    assert by[5] == "just words & more" and by[8] == "\n".join(["word"] * 30000)
    assert extract(df.limit(0)).collect() == []
    w = weights(df.limit(0))
    assert main_text(PAGE, w) == TEXT


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        h = html[r.page_id]
        inner = h[h.index("<article>") : h.index("</article>")]
        assert r.text.split("\n")[0] in __import__("html").unescape(inner)
        assert "©" not in r.text and len(r.text) >= 0.7 * len(inner) - 400


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = docs.limit(300).select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "123 ## $$", "de"), (-4, "zzz", None), (None, None, None), (-5, "the of and " * 50000, "en")], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in identify(odd).collect()}
    assert len(got) == 306 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3, None)) and got[-5].lang_pred == "en"
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify(none).first().lang_pred == "und" and identify(none.limit(0)).collect() == []


def test_ftrl_matches_its_definition():
    """Coordinate by coordinate: proximal steps with per-coordinate rates, l1 and l2, over the same batches."""
    rng = np.random.default_rng(0)
    docs = [(np.array(sorted(rng.choice(6, 3, replace=False))), rng.integers(1, 4, 3)) for _ in range(9)]
    y = np.array([0, 1, 2] * 3)
    idf = np.linspace(1, 2, 6).astype(np.float32)
    model = Regression(["a", "b", "c"], idf)
    model.fit(docs, y, epochs=3)
    x = np.zeros((9, 7))
    for i, (k, c) in enumerate(docs):
        x[i, k] = SCALE * idf[k] * c / c.sum()
    x[:, 6] = 1
    z, n, w = np.zeros((3, 7)), np.zeros((3, 7)), np.zeros((3, 7))
    order = np.random.default_rng(42)
    for _ in range(3):
        part = order.permutation(np.arange(9))
        p = np.exp(x[part] @ w.T)
        p /= p.sum(1, keepdims=True)
        for c in range(3):
            for j in range(7):
                g = sum((p[r, c] - (y[i] == c)) * x[i, j] for r, i in enumerate(part)) / 9
                z[c, j] += g - (np.sqrt(n[c, j] + g * g) - np.sqrt(n[c, j])) / 0.2 * w[c, j]
                n[c, j] += g * g
        for c in range(3):
            for j in range(7):
                w[c, j] = 0 if abs(z[c, j]) <= 0.02 else -(z[c, j] - np.sign(z[c, j]) * 0.02) / ((1 + np.sqrt(n[c, j])) / 0.2 + 0.02)
    assert np.allclose(np.hstack([model.weights, model.bias[:, None]]), w, atol=2e-4)


def test_langid_clashes_repeats_and_many_short_texts(spark):
    rows = [(i, ["ab cd ef", "xy zz wx", "ab ef"][i % 3], ["p", "q", None][i % 3], "k", i) for i in range(3000)] + [(0, "ab cd ef", "p", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, score int")
    got = identify(df).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 0 for r in got) == 2
    assert {(r.lang_pred, r.score) for r in got if r.doc_id % 3 == 0}.__len__() == 1
    assert all(r.lang_pred == "pqp"[r.doc_id % 3] for r in got)


def test_every_language_is_learned(spark):
    rows = [(3 * i + j, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i) * 2}", f"l{i}") for i in range(1010) for j in range(3)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)
