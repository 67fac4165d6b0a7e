"""URL verdicts by rules and link-graph propagation (operator 7), in built-in column functions only.

Rules decide the pages that they fit. For the others, hosts are judged: personalised PageRank carries
trust from hosts with allowed pages along host links, and distrust from hosts with blocked pages against them; a host
is blocked where distrust is at least ``threshold`` of both. A host without evidence is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, staged

# Fixed values of the query: action, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
HREF = r"(?i)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'>\s]+)"
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.8
HUB_LINKS, BROADCAST_HOSTS = 100_000, 200_000
_UP, _LOW = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))


def _parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UP, _LOW), path


def judge_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (``page_id, url``) with ``host, path, rule, action``; of the rules that fit, the longest counts."""
    host, path = _parts(F.col("url").cast("string"))
    df = pages.withColumn("host", host).withColumn("path", path)
    rule = action = None
    for act, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return df.withColumn("rule", rule if rules else F.lit(None).cast("string")).withColumn("action", action if rules else F.lit(None).cast("string"))


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts in the html of ``pages`` (``host, html``)."""
    to = F.explode(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: F.translate(x, _UP, _LOW)))
    has = F.contains(F.col("html"), F.lit("//"))
    links = pages.where(has).select(F.col("host").alias("src"), to.alias("dst"))
    return links.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank over ``src, dst, n`` from ``host, seed`` (seeds sum up to 1): ``host, rank``, summing up to 1.

    What a host without links out would pass on returns to the seeds, which is to scale the ranks without it. Rounds go on
    until no host is newly reached and the ranks' summed change is below ``tolerance``. The links of a host with many
    are dealt to parts of about HUB_LINKS. No seeds: no ranks; no links: the seeds.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / F.lit(float(HUB_LINKS))).cast("int").alias("parts"))
    out = staged(out, "sources")
    step = edges.join(out, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), (F.col("n") / F.col("total") * damping).alias("share"))
    step = staged(step, "steps")
    sent = out.select("src", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    start = staged(seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank")), "seeds")
    rank, hosts = start, start.count()
    while True:
        new = rank
        for _ in range(4):
            own = new.join(sent, new.host == sent.src).select("src", "part", "rank")
            moved = step.join(own, ["src", "part"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
            new = moved.union(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        new = staged(new, "rank")
        both = new.union(rank.select("host", -F.col("rank"))).groupBy("host").agg(F.abs(F.sum("rank")).alias("change"))
        change, total = both.agg(F.coalesce(F.sum("change"), F.lit(0.0))).first()[0], new.agg(F.coalesce(F.sum("rank"), F.lit(0.0)), F.count("*")).first()
        if rank is not start:
            dropped(rank)
        done, rank, hosts = total[1] == hosts and change <= tolerance * total[0], new, total[1]
        if done:
            dropped(step, out)
            return rank.select("host", (F.col("rank") / F.lit(total[0] or 1.0)).alias("rank"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``pages`` (``page_id, url, html``): ``page_id, host, path, rule, verdict``.

    Null urls and those without ``://`` have an empty host and path, and are allowed where no rule fits. Null html has no links. Rules
    are few: each is an expression. Repeated rows are judged each; an empty table gives no rows; other columns are not read.
    """
    ruled = judge_by_rules(pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), rules)
    slim = staged(ruled.select("page_id", "host", "path", "rule", "action"), "ruled")
    evidence = staged(slim.where("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("good"), F.count_if(F.col("action") == "block").alias("bad")), "hosts")
    good, bad = evidence.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    links = staged(host_links(ruled), "links")
    score = {}
    for name, total, edges in (("good", good, links), ("bad", bad, links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        seeds = evidence.where(F.col(name) > 0).select("host", (F.col(name) / F.lit(max(total, 1))).alias("seed"))
        score[name] = propagate(edges, seeds).withColumnRenamed("rank", name)
    # back to pages: a host's trust and distrust are weighed by the evidence that there is of either
    hosts = score["good"].join(score["bad"], "host", "full").select("host", (F.coalesce("good", F.lit(0.0)) * good).alias("t"), (F.coalesce("bad", F.lit(0.0)) * bad).alias("d"))
    blocked = staged(hosts.where((F.col("d") > 0) & (F.col("d") >= threshold * (F.col("d") + F.col("t")))).select("host", F.lit("block").alias("judged")), "blocked")
    if blocked.count() <= BROADCAST_HOSTS:
        blocked = F.broadcast(blocked)
    asked = F.col("action").isNull() & (F.col("host") != "")  # only these need a host's verdict
    judged = slim.where(asked).join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("judged", F.lit("allow")).alias("verdict"))
    return judged.union(slim.where(~asked).select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict")))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host verdicts for every row of ``pages``, by ``judge``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
