"""Personal data by weak-supervision aggregation (operator 2), in built-in column functions only.

Spans of the exact base patterns are always reported. Looser candidates (spelled-out addresses, numbers
without country code, card groups inside longer runs, IPv6) are voted on, together with the base
spans, by labelers: a format labeler, gazetteers of domains, issuers and reserved networks, the words before the
span, and the characters next to it. Expectation-maximisation over the counts of the vote patterns
(at most 4 kinds times 3 to the number of labelers, whatever the corpus) estimates each labeler's reliability. The
resulting posteriors label the spans on which a logistic classifier is trained; it sees the span itself (how many digits, what
parts them), the characters on either side and the votes, and decides which candidates are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged

KINDS = ("email", "ip", "card", "phone")
# The base patterns with the same matches in linear time: runs are possessive, and a run that cannot match is not tried again from its middle.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Whether a text can have a match at all, tested first.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\(\[{](?i:at)[\)\]}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\(\[{](?i:dot)[\)\]}])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
}
LOOSE_HINT = {"email": r"[\(\[{](?i:at)[\)\]}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "card": r"[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}", "phone": r"[0-9]{3}[.\x20-][0-9]{4}(?![0-9])"}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|adresse)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|address|client|addr)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte|payment|pan)\b",
    "phone": r"(?i)\b(?:tel|phone|telephone|call|mobile|cell|fax|sms|whatsapp|tel[eé]fono|t[eé]l[eé]phone|telefon|handy)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|order|invoice|serial|id|no|ref|part|page|model|build|lot|doi)\b[\s:.#]*$"
GAZETTEER = {  # what known values look like: top domains, issuer prefixes, routable first parts, area codes
    "email": r"(?i)(?:\.|dot[\)\]}]\x20?)(?:com|org|net|edu|gov|io|info|biz|co|us|uk|de|fr|es|it|nl|eu|ru|jp|cn|in|br|ca|au|ch|at|be|se|no|pl)$",
    "ip": r"^(?!0|127\.|255\.)(?:[0-9.]+$|[23][0-9A-Fa-f]{3}:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|3[068]|35)",
    "phone": r"^(?:\+|\(?[2-9][0-9]{2})",
}
SPAN = "array<struct<s:int,kind:int,e:int,base:boolean,votes:string,shape:string>>"
LABELERS = 4
THRESHOLD = 0.9
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _spans(text: Column, pattern: str, possible: Column) -> Column:
    """``s, e, m`` of all matches, in code points: what splitting leaves between the matches tells their places."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    zipped = F.zip_with(matches, between, lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    found = F.aggregate(F.filter(zipped, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.when(possible, found).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    d = _digits(m)
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def _sign(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))


def _votes(kind: str, text: Column, x: Column) -> Column:
    """One of ``+0-`` of each labeler: format, gazetteer, context, neighbours."""
    d, before, after = _digits(x["m"]), F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))), F.substring(text, x["e"] + 1, 1)
    form = {"email": F.lit("+"), "ip": F.lit("+"), "card": F.when(F.call_function("luhn_check", d), F.lit("+")).otherwise(F.lit("-")), "phone": _sign(F.length(d).between(10, 15), F.lit(True))}[kind]
    known = _sign(x["m"].rlike(GAZETTEER[kind]), ~x["m"].rlike(GAZETTEER[kind]))
    context = _sign(before.rlike(CONTEXT[kind]), before.rlike(AGAINST))
    beside = F.substring(before, -1, 1).rlike(r"[\p{L}0-9_=/\"]") | after.rlike(r"[\p{L}0-9_=/\"]")
    return F.concat(form, known, context, _sign(~F.coalesce(beside, F.lit(False)), F.lit(True)))


def _shape(text: Column, x: Column) -> Column:
    """Four characters: how many digits, what parts them, and what stands before and after."""
    n = F.length(_digits(x["m"]))
    size = F.when(n == 0, "0").when(n < 10, "1").when(n < 13, "2").when(n < 16, "3").otherwise("4")
    parts = F.when(x["m"].contains("("), "(").when(x["m"].contains("-"), "-").when(x["m"].contains(" "), "s").when(x["m"].contains("."), ".").otherwise("0")
    side = lambda c: F.when(c.rlike(r"^\s"), "s").when(c.rlike(r"^[\p{L}0-9]"), "a").when(c != "", "p").otherwise("0")
    before = F.when(x["s"] > 0, F.substring(text, F.greatest(x["s"], F.lit(1)), F.lit(1))).otherwise("")
    return F.concat(size, parts, side(before), side(F.substring(text, x["e"] + 1, F.lit(1))))


def _only_valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["m"]))


def _voted(k: int, text: Column, spans: Column, base: bool) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("kind"), x["e"].alias("e"), F.lit(base).alias("base"), _votes(KINDS[k], text, x).alias("votes"), _shape(text, x).alias("shape")))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spans``: all base spans and loose candidates as ``kind, s, e, base, votes, shape``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("text", text)
    t = F.col("text")
    columns = []
    for k, kind in enumerate(KINDS):
        hint, loose_hint = HINT[kind], LOOSE_HINT[kind]
        may = F.contains(t, F.lit(hint)) if len(hint) == 1 else t.rlike(hint)
        df = df.withColumn(f"_b{k}", _only_valid(kind, _spans(t, BASE[kind], may)))
        df = df.withColumn(f"_l{k}", _spans(t, LOOSE[kind], t.rlike(loose_hint)))
        columns += [_voted(k, t, F.col(f"_b{k}"), True), _voted(k, t, F.col(f"_l{k}"), False)]
    df = df.withColumn("_all", F.when(F.size("_b0") + F.size("_b1") + F.size("_b2") + F.size("_b3") + F.size("_l0") + F.size("_l1") + F.size("_l2") + F.size("_l3") > 0, F.sort_array(F.concat(*columns))))
    free = F.filter("_all", lambda x: x["base"] | ~F.exists("_all", lambda y: y["base"] & (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return df.withColumn("spans", F.coalesce(free, F.array().cast(SPAN))).drop("_all", *(f"_{c}{k}" for c in "bl" for k in range(4)))


def reliabilities(patterns: dict[tuple[int, str], float], rounds: int = 50) -> dict[tuple[int, str], float]:
    """Posterior of each vote pattern of each kind by expectation-maximisation over independent labelers."""
    out = {}
    for kind in {k for k, _ in patterns}:
        own = {v: n for (k, v), n in patterns.items() if k == kind}
        prior = 0.5
        like = [[{"+": 0.7, "0": 0.2, "-": 0.1}, {"+": 0.2, "0": 0.3, "-": 0.5}] for _ in range(LABELERS)]
        post: dict[str, float] = {}
        for _ in range(rounds):
            for v in own:
                a = math.log(prior) + sum(math.log(like[i][0][c]) for i, c in enumerate(v))
                b = math.log(1 - prior) + sum(math.log(like[i][1][c]) for i, c in enumerate(v))
                post[v] = 1 / (1 + math.exp(min(700.0, b - a)))
            total = sum(own.values())
            prior = min(max((sum(n * post[v] for v, n in own.items()) + 1) / (total + 2), 1e-3), 1 - 1e-3)
            for i in range(LABELERS):
                for side in (0, 1):
                    weight = {c: (0.5, 1.0, 3.0)[(side == 0) * 2 if c == "+" else (side == 1) * 2 if c == "-" else 1] for c in "+0-"}
                    for v, n in own.items():
                        weight[v[i]] += n * (post[v] if side == 0 else 1 - post[v])
                    like[i][side] = {c: w / sum(weight.values()) for c, w in weight.items()}
        out |= {(kind, v): p for v, p in post.items()}
    return out


def classifier(patterns: dict[tuple[int, str, str], float], posterior: dict[tuple[int, str], float], steps: int = 300, rate: float = 0.5) -> dict[tuple[int, str, str], float]:
    """Probabilities, by kind, votes and shape, of a logistic classifier on both, trained on the posteriors of the votes."""
    weight: dict[tuple, float] = {}
    keys = {p: [("bias", p[0]), *((p[0], "vote", i, c) for i, c in enumerate(p[1])), *((p[0], "shape", i, c) for i, c in enumerate(p[2]))] for p in patterns}
    probability = lambda p: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(f, 0.0) for f in keys[p])))))
    by_kind = {k: sum(n for p, n in patterns.items() if p[0] == k) or 1.0 for k in range(len(KINDS))}
    for _ in range(steps):
        grad: dict[tuple, float] = {}
        for p, n in patterns.items():
            g = n / by_kind[p[0]] * (posterior[p[:2]] - probability(p))
            for f in keys[p]:
                grad[f] = grad.get(f, 0.0) + g
        for f, g in grad.items():
            weight[f] = weight.get(f, 0.0) * (1 - 1e-4) + rate * g
    return {p: probability(p) for p in patterns}


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``spans``: all base spans, and the candidates that the classifier finds likely, by start and kind.

    Null and empty texts have none. Spans count code points, the end exclusive; additions never overlap base spans.
    All columns of ``docs`` stay (one named ``spans`` is replaced).
    """
    got = staged(candidates(docs), "candidates")
    rows = got.where(F.size("spans") > 0).select(F.explode("spans").alias("x")).groupBy("x.kind", "x.votes", "x.shape").agg(F.count("*").alias("n")).collect()  # 4 kinds, 81 votes, 400 shapes
    patterns, votes = {(r.kind, r.votes, r.shape): float(r.n) for r in rows}, {}
    for (k, v, _), n in patterns.items():
        votes[k, v] = votes.get((k, v), 0.0) + n
    accepted = sorted(f"{k}{v}{w}" for (k, v, w), p in classifier(patterns, reliabilities(votes)).items() if p >= threshold)
    yes = lambda x: x["base"] | F.concat(x["kind"].cast("string"), x["votes"], x["shape"]).isin(accepted) if accepted else x["base"]
    return got.withColumn("spans", F.filter("spans", yes))


def _listed(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; null texts become empty."""
    t, name = F.col("text"), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(name, x["kind"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return find(docs, threshold).withColumn("text", F.when(F.size("spans") > 0, text).otherwise(t)).drop("spans")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hashes of the base spans and all spans found in every whole text of ``documents``, by ``find``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = find(docs).withColumn("own", F.filter("spans", lambda x: x["base"]))
    count = lambda k: F.size(F.filter("own", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return got.select("doc_id", *(count(k) for k in range(len(KINDS))), F.sha2(_listed(F.col("own")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
