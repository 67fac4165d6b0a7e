"""Mixing sources to target weights by subset-sum budget fitting (operator 4).

Documents are counted by source and exact length. Each source's target is met by whole copies of all
its documents and a remaining budget, which is fitted on the counts alone: every length gives its
proportional share, and a bounded-knapsack dynamic program over the lengths left fills the rest. Then
the counts are turned into documents: of each length the ones with the smallest seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
#: What the dynamic program works on: sums below the first (its memory), and about the second of them over all its steps.
DP_SUMS, DP_WORK = 1 << 25, 1 << 32
#: A length that so many documents of a source have is joined by broadcast; there is at most one a HOT_ROWS documents.
HOT_ROWS = 1 << 20


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, copies: int = 1, seed: int = 42) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum up to ``budget`` or as near below as found.

    Each document may be taken up to ``copies`` times. Every size gives its proportional share; while what is left is more
    than the dynamic program's range, the largest sizes that fit are taken; then as much is given back as the range holds,
    and the bounded-knapsack program fills it exactly. So the result is the best one wherever the budget fits the range.
    """
    take, some = np.zeros(len(sizes), np.int64), np.flatnonzero((sizes > 0) & (counts > 0))
    if budget <= 0 or not len(some):
        return take
    unit = int(np.gcd.reduce(sizes[some]))
    size, count, budget = (sizes[some] // unit).tolist(), counts[some].tolist(), budget // unit
    total, most = sum(s * n for s, n in zip(size, count, strict=True)), [copies * n for n in count]
    got = [min(m, n * budget // total) for m, n in zip(most, count, strict=True)]
    left = budget - sum(s * k for s, k in zip(size, got, strict=True))
    order = np.random.default_rng(seed).permutation(len(size)).tolist()
    steps = sum(m.bit_length() for m in most)
    span = min(DP_SUMS, max(DP_WORK // steps, 1 << 17))
    start, rest = got, left
    for room in (1 << 14, span):  # the small range fills most budgets to the last word, in little time
        got, left = list(start), rest
        for i in sorted(order, key=lambda i: -size[i]):
            if left <= room:
                break
            more = min(most[i] - got[i], left // size[i])
            got[i], left = got[i] + more, left - more * size[i]
        tried = list(got)
        if left <= room and _fill(size, tried, most, left, order) == 0:
            take[some] = tried
            return take
    if spare := [s for s, k, m in zip(size, got, most, strict=True) if k < m]:
        span = max(span, min(2 * min(spare), DP_SUMS))
        for i in order:
            back = min(got[i], max(span - left, 0) // size[i])
            got[i], left = got[i] - back, left + back * size[i]
        _fill(size, got, most, left, order)
    take[some] = got
    return take


def _fill(size: list[int], got: list[int], most: list[int], left: int, order: list[int]) -> int:
    """Add to ``got``, up to ``most``, so that ``left`` is filled as far as it can be, and return what remains: each sum notes the step that first reached it."""
    reach, first, steps = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int32), []
    reach[0] = True
    for i in order:
        free, part = min(most[i] - got[i], left // size[i]), 1
        while free > 0 and not reach[left]:  # binary split of the bounded count
            part = min(part, free)
            new = np.flatnonzero(reach[: left + 1 - size[i] * part]) + size[i] * part
            new = new[~reach[new]]
            reach[new], first[new] = True, len(steps)
            steps.append((i, part))
            free, part = free - part, part * 2
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    rest = left - at
    while at:  # the sum before a step was reached by earlier ones
        i, part = steps[first[at]]
        got[i] += part
        at -= part * size[i]
    return rest


def targets(hist: DataFrame) -> DataFrame:
    """``source, source_size, target`` from counts by ``source`` and ``size``.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Resharing the excess of capped sources by
    weight ends at the level where the targets ``min(3 * size, level * weight)`` sum up to all sizes.
    """
    src = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    src = src.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % 3 + 1)
    src = src.withColumn("cap", F.lit(MOST_COPIES) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    up = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    src = src.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("full_at"))).over(every))
    return src.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def _quota(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")  # the same choice whatever the order of the counts
    total, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    budget = round(target)
    whole = min(MOST_COPIES, budget // total) if total else 0
    extra = fit_budget(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget - whole * total if whole < MOST_COPIES else 0, MOST_COPIES - whole)
    return pdf.assign(whole=whole, k=extra)[["source", "size", "n", "source_size", "target", "whole", "k"]]


def _by_length(rows: DataFrame, table: DataFrame, hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (``s, z, n``) by source and size: the lengths of many documents by broadcast, so no task gets
    all documents of one, the others as the planner likes. Rows that do not have their ``n`` are told apart by ``hot``."""
    same = lambda t: F.col("source").eqNullSafe(t.s) & (F.col("size") == t.z)
    often, seldom = table.where(F.col("n") >= HOT_ROWS), table.where(F.col("n") < HOT_ROWS)
    if hot is not None:
        many, few = rows, rows.join(F.broadcast(hot), same(hot), "left_anti")
    else:
        many, few = rows.where(F.col("n") >= HOT_ROWS), rows.where(F.col("n") < HOT_ROWS)
        often, seldom = often.drop("n"), seldom.drop("n")
    return many.join(F.broadcast(often), same(often), how).drop("s", "z").unionByName(few.join(seldom, same(seldom), how).drop("s", "z"))


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    Size: words of the text (null: 0). ``copies`` is 0 to 3, ``taken`` is ``copies * size``. Rows that tie in the
    seeded hash (repeated ids) are told apart by their place. Null is a source of its own; documents of size 0
    take nothing; an empty table gives no rows; other columns are not read.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = staged(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    hist = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    goal = targets(hist).withColumnRenamed("source", "s")
    quota = hist.join(goal, hist.source.eqNullSafe(goal.s)).drop("s")
    quota = staged(quota.groupBy("source").applyInPandas(_quota, "source string, size long, n long, source_size long, target double, whole long, k long"), "quota")
    bits = F.ceil(F.log2(F.col("n") / 256)).cast("int")  # the hashes of one length in ranges of about 256
    q = quota.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "whole", "k", "n", F.greatest(bits, F.lit(0)).alias("bits"))
    h = F.xxhash64(F.lit(seed), "doc_id")
    # k copies over n documents: each gets k / n, and the first k mod n one more
    q = q.withColumn("whole", F.col("whole") + F.floor(F.col("k") / F.col("n"))).withColumn("k", F.col("k") % F.col("n"))
    each = _by_length(sizes, q, q.where(F.col("n") >= HOT_ROWS).select("s", "z")).withColumn("h", h)
    # the sign bit is put last so that ranges are of unsigned hashes
    each = each.withColumn("range", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)")))
    spans = each.where("k > 0").groupBy("source", "size", "range", "k", "n").agg(F.count("*").alias("m"))
    below = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = spans.withColumn("below", below).where((F.col("below") < F.col("k")) & (F.col("below") + F.col("m") >= F.col("k")))
    edge = edge.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", F.col("range").alias("last"), (F.col("k") - F.col("below")).alias("need"))
    each = staged(_by_length(each, edge, how="left"), "mixed")
    at_edge = each.where("range = last").withColumn("rank", F.row_number().over(Window.partitionBy("source", "size").orderBy("h", "row"))).withColumn("extra", (F.col("rank") <= F.col("need")).cast("long")).drop("rank")
    rest = each.where("last is null or range <> last").withColumn("extra", F.coalesce(F.col("range") < F.col("last"), F.lit(False)).cast("long"))
    out = rest.unionByName(at_edge).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every row of ``documents``, by ``mix``; null texts have size 0, repeated rows are taken each."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
