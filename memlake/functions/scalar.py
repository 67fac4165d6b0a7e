"""Retention, affect, intention, clock, trust and vector expressions.

All maths is in double precision and takes an explicit ``as_of``; nothing reads the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400
MIN_STABILITY = 0.1
RECALL_OK, RECALL_FAIL, BASE_GAIN = 1.5, 0.9, 1.05
VALENCE_EDGE = 0.3


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from ``a`` to ``b``, truncated."""
    return F.timestamp_diff("SECOND", a, b)


def retention(base: Column, last_recall: Column, stability: Column, as_of: Column) -> Column:
    """Strength on the forgetting curve; a recall in the future gives more than ``base``."""
    tau = F.greatest(stability, F.lit(MIN_STABILITY)) * DAY_S
    return base * F.exp(-seconds_between(last_recall, as_of) / tau)


def forget_time(base: Column, last_recall: Column, stability: Column, threshold: Column) -> Column:
    """When strength falls to ``threshold``; null where it is there already. Stability is not floored here."""
    s = (-stability * DAY_S * F.ln(threshold / base)).cast("long")
    return F.when((threshold < base) & (s > 0), F.timestamp_add("SECOND", s, last_recall))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def pad(p: Column, a: Column, d: Column) -> Column:
    """A pleasure-arousal-dominance vector, each part clamped to -1..1."""
    return F.struct(*(clamp(x.cast("double"), -1.0, 1.0).alias(n) for x, n in ((p, "pleasure"), (a, "arousal"), (d, "dominance"))))


def pad_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow(a[k] - b[k], F.lit(2.0)) for k in ("pleasure", "arousal", "dominance")), F.lit(0.0)))


def intensity(a: Column) -> Column:
    return pad_distance(a, pad(F.lit(0), F.lit(0), F.lit(0)))


def valence(pleasure: Column) -> Column:
    return F.when(pleasure > VALENCE_EDGE, "positive").when(pleasure < -VALENCE_EDGE, "negative").otherwise("neutral")


def is_active(status: Column) -> Column:
    return status.isin("Pending", "Active")


def should_trigger(status: Column, kind: Column, at: Column, as_of: Column, after_s: Column | None = None, created_at: Column | None = None, event: Column | None = None, events: list[str] | None = None, contexts: Column | None = None, current: list[str] | None = None) -> Column:
    """Whether an open intention fires now.

    Immediate and time triggers fire by default. Delays, events and contexts fire only where the
    caller passes what they are compared with.
    """
    fires = (kind == "Immediate") | ((kind == "TimeBasedAt") & (at <= as_of))
    if after_s is not None and created_at is not None:
        fires |= (kind == "TimeBasedAfter") & (F.timestamp_add("SECOND", after_s, created_at) <= as_of)
    if event is not None and events:
        fires |= (kind == "EventBased") & event.isin(events)
    if contexts is not None and current:
        fires |= (kind == "ContextBased") & F.arrays_overlap(contexts, F.array(*map(F.lit, current)))
    return F.coalesce(is_active(status) & fires, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for different lengths and zero norms, null for null arrays."""
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def clock_order(a: Column, b: Column) -> Column:
    """``greater``, ``less``, ``equal`` or ``concurrent``; nodes that a clock lacks count as 0."""
    diff = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    up, down = F.exists(diff, lambda x: x > 0), F.exists(diff, lambda x: x < 0)
    return F.when(up & down, "concurrent").when(up, "greater").when(down, "less").otherwise("equal")


def clock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def clock_get(clock: Column, node: str) -> Column:
    return F.coalesce(F.try_element_at(clock, F.lit(node)), F.lit(0))


def decayed_trust(value: Column, days: Column) -> Column:
    """Trust drifting back to one half, kept within 0.1 and 0.95; null (an unknown source) is one half."""
    return F.coalesce(clamp(F.lit(0.5) + (value - 0.5) * F.exp(F.lit(-0.01) * days), 0.1, 0.95), F.lit(0.5))


def base_trust(category: Column) -> Column:
    return F.when(category == "User", 0.8).when(category == "System", 0.7).when(category == "Derived", 0.4).otherwise(0.5)


def edge_id(src: Column, relationship: Column, dst: Column) -> Column:
    return F.concat_ws("-", src, relationship, dst)


def tokens(text: Column) -> Column:
    """Words between white space (of Unicode); none for null or blank text."""
    return F.coalesce(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""), F.array().cast("array<string>"))


def chunked(text: Column, size: int = 512) -> Column:
    """The text in pieces of ``size`` characters."""
    n = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
