import hashlib
import random
import re

from memlake.llm import pii
from memlake.llm.urlgraph import RULES, judge, propagate

RAW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(RAW):
        for m in re.finditer(RAW[kind], text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(out))


TEXTS = [
    None, "", "😀 a.b@c-d.example.com, x@y", "a@b.c_d@e.f@g.h", "1.2.3.4.5 999.1.1.1 0001.02.3.255 1.2.3.256", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (509) 555-6973 190.137.223.204",
    "+49 (0) 30--1234567 .", "4539578763621486", "é" * 50 + "4539578763621486@mail.example.org", "@" * 100 + "a@b.co.", "a" * 50000 + " " + "1.2." * 8000 + "@x", "mail me: jane (at) site (dot) com", "call 555-123-4567 now", "card 4111 1111 1111 1111 12",
]


def test_base_spans_and_additions(spark):
    rnd = random.Random(7)
    parts = ["a@b.com", "x.y+z@q-r.org", "10.0.0.1", "300.1.1.1", "4111111111111111", "5500 0000 0000 0004", "+1 (222) 555-0199", "+4930123456", "é", "😀", ",", " ", ".", "-", "@", "+", "9", "_"]
    texts = TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(df).withColumn("own", pii._listed(pii.F.filter("spans", lambda x: x["base"]))).withColumn("all", pii._listed(pii.F.col("spans"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].own == brute(t), (t, got[i].own, brute(t))
        assert set(got[i].own.split(",")) <= set(got[i].all.split(",")) or not got[i].own
    assert pii.find(df.limit(0)).collect() == []


def test_query_and_redaction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.op2_pii(spark, "/root/testdata/sf0.001").collect():
        assert r.base_sha256 == hashlib.sha256(brute(text[r.doc_id]).encode()).hexdigest()
    df = spark.createDataFrame([(1, "to a@b.com and 10.0.0.1!", "en"), (2, None, "en"), (3, "clean", "en"), (4, "+1 4111 1111 1111 1111", "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got[1] == "to [EMAIL] and [IP]!" and got[2] == "" and got[3] == "clean" and "4111" not in got[4]


def test_aggregation_learns_reliable_labelers():
    patterns = {(3, "++++"): 500.0, (3, "++0+"): 300.0, (3, "-0--"): 400.0, (3, "-+--"): 200.0}
    post = pii.reliabilities(patterns)
    assert post[(3, "++0+")] > 0.9 > 0.1 > post[(3, "-+--")]
    shaped = {(k, v, "2-ss" if v[0] == "+" else "4-aa"): n for (k, v), n in patterns.items()} | {(3, "+0++", "2-ss"): 9.0, (3, "+0++", "4-aa"): 9.0}
    p = pii.classifier(shaped, post | {(3, "+0++"): 0.8})
    assert p[(3, "++++", "2-ss")] > 0.9 and p[(3, "-0--", "4-aa")] < 0.1
    assert p[(3, "+0++", "2-ss")] > p[(3, "+0++", "4-aa")] + 0.05  # the span itself counts, not the votes alone


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


def test_urls(spark):
    urls = [None, "", "no scheme/x", "http://A.ORG/x?y#z", "https://org", "ftp://example.org/es/1", "http://a.example.org/en/12", "x://y://z.com/fr/", "http://É.com/de/q", "http://u@h.com:80/en/", "http://notorg/", "http://bad.com/de/a", "http://bad.com/en/", "http://near.net/x", "http://far.net/"]
    html = ["<a href='http://bad.com/q'>", None, ""] + ["<a href=\"//near.net/1\"><a HREF=http://far.net>"] * 12
    rows = [(i, u, html[i], "c") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    got = judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1])
        assert rule is None or r.verdict == rule[2]
    by = {r.page_id: r.verdict for r in got}
    assert by[12] == "block" and by[0] == "allow"
    assert judge(df.limit(0)).collect() == []


def brute_rank(edges, seeds):
    """Personalised PageRank whose dangling mass returns to the seeds, by power iteration."""
    hosts = {x for s, d, _ in edges for x in (s, d)} | set(seeds)
    out = {h: sum(n for s, _, n in edges if s == h) for h in hosts}
    rank = dict.fromkeys(hosts, 0.0) | seeds
    for _ in range(400):
        lost = sum(rank[h] for h in hosts if not out[h])
        new = {h: (0.15 + 0.85 * lost) * seeds.get(h, 0) for h in hosts}
        for s, d, n in edges:
            new[d] += 0.85 * rank[s] * n / out[s]
        rank = new
    return {h: r for h, r in rank.items() if r}


def test_propagation_matches_power_iteration(spark, monkeypatch):
    from memlake.llm import urlgraph

    monkeypatch.setattr(urlgraph, "HUB_LINKS", 2)
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1), ("c", "e", 2), ("c", "f", 1), ("f", "g", 1)]
    seeds = {"a": 0.75, "d": 0.25}
    frame = lambda e: spark.createDataFrame(e, "src string, dst string, n long")
    start = spark.createDataFrame(list(seeds.items()), "host string, seed double")
    got = {r.host: r["rank"] for r in propagate(frame(edges), start, tolerance=1e-9).collect()}
    want = brute_rank(edges, seeds)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-7 for h in want)
    assert {r.host: round(r["rank"], 9) for r in propagate(frame([]), start).collect()} == seeds
    assert propagate(frame(edges), start.limit(0)).collect() == []


def test_verdicts_end_to_end(spark):
    """A chain of 30 hosts leads to a blocked one, others to allowed ones or both, hubs and repeated rows among them; every verdict is checked."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(0, "http://bad.com/de/1", None), (1, "http://good.org/a", link("n1.net", "n2.net")), (2, "http://n1.net/", link("n3.net")), (3, "http://n2.net/p", link("bad.com", "good.org")), (4, "http://lone.net/", None)]
    rows += [(10 + i, f"http://c{i}.net/", link(f"c{i + 1}.net" if i < 29 else "bad.com")) for i in range(30)]
    rows += [(50, "http://hub.net/", link(*(f"c{i}.net" for i in range(0, 30, 3)), "good.org", "good.org")), (51, "nothing", link("bad.com")), (52, None, None), (4, "http://lone.net/", None), (53, "http://bad.com/en/", None)]
    got = {(r.page_id, r.host): r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    count, edges = {"allow": {}, "block": {}}, {}
    for _, url, html in rows:
        host, _, rule = brute_rule(url)
        if rule:
            count[rule[2]][host] = count[rule[2]].get(host, 0) + 1
        for to in re.findall(r"//([^/]+)/x", html or ""):
            if host and host != to:
                edges[host, to] = edges.get((host, to), 0) + 1
    score = {}
    for kind, links in (("allow", [(s, d, n) for (s, d), n in edges.items()]), ("block", [(d, s, n) for (s, d), n in edges.items()])):
        total = sum(count[kind].values())
        score[kind] = {h: r * total for h, r in brute_rank(links, {h: n / total for h, n in count[kind].items()}).items()}
    assert len(got) == len(rows) - 1
    for i, url, _ in rows:
        host, _, rule = brute_rule(url)
        d, t = score["block"].get(host, 0), score["allow"].get(host, 0)
        assert got[i, host] == (rule[2] if rule else "block" if d > 0 and d >= 0.8 * (d + t) else "allow"), url
    assert got[10, "c0.net"] == "block" and got[4, "lone.net"] == "allow" and got[2, "n1.net"] == "allow"
