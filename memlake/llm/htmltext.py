"""Main-text extraction from HTML by a maximum-scoring subsequence (operator 9).

A page is a sequence of tokens: words and tags. Pages that mark their own main part (article or main
elements) label their tokens; over all such pages the log ratio of a token type's share inside and
outside gives its weight, words positive and tags negative; on pages without a marked main part, words weigh by the element
that holds them. A linear scan then finds the contiguous
run with the greatest sum, and its blocks, without those in boilerplate containers, are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is no page text, elements that start a new block, elements without content.
RAW = "script style noscript template svg math iframe object canvas audio video select button textarea title head datalist map"
BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul"
VOID = "area base br col embed hr img input link meta param source track wbr"
INLINE = "a abbr acronym b bdi bdo big caption cite code col colgroup data del dfn em font i ins kbd label mark meter output picture progress q rp rt ruby s samp slot small span strike strong sub sup td th time tt u var"
ASIDE = "nav header footer aside form dialog menu search"
ROLES = "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note"
# Words of class and id names that mark what is not the article.
MARKS = (
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar side-bar menu nav navbar navigation navigator breadcrumb breadcrumbs topbar masthead header footer foot copyright comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations "
    "more-stories teaser widget pagination pager paging toolbar skip hidden form search outbrain taboola tags"
)

#: Words that a holder's weight is drawn to the weight of all words by, and the least share of that weight that it keeps.
PRIOR, LEAST = 100, 0.5

_KNOWN = frozenset(f"t:{x}" for x in f"{RAW} {BLOCKS} {VOID} {INLINE}".split())
_RAW, _BLOCKS, _VOID, _ASIDE = (frozenset(x.split()) for x in (RAW, BLOCKS, VOID, ASIDE))
_HOLDERS = _BLOCKS | {"a", "td", "th"}
_ROLES, _MARKS = frozenset(ROLES.split()), frozenset(MARKS.split())
_TOKEN = re.compile(
    r"<!--(?:.*?-->|>)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?</(?P=raw)\s*>"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)>"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)(?=\s|/|$)", re.I)
# Implied end tags: what a start tag ends inside its table or list, what ends an open p, what shields p from that, and what shields li, dt and dd.
_CELLS = frozenset("caption colgroup td th".split())
_ENDS = dict.fromkeys(("td", "th"), _CELLS) | {"tr": _CELLS | {"tr"}} | dict.fromkeys(("tbody", "thead", "tfoot"), _CELLS | {"tr", "tbody", "thead", "tfoot"})
_ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_ENDS_P = _BLOCKS - set("html body tr tbody thead tfoot legend optgroup option".split())
_HOLDS_P = ("table", "td", "th", "caption", "button", "object", "marquee")
_WALLS = _BLOCKS - {"address", "div", "p"} | _CELLS | {"button", "select", "object", "marquee"}


def _marked(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element and all in it is boilerplate."""
    if tag in _RAW or tag in _ASIDE and not (tag == "header" and in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = (m[1] or "hidden").lower(), (m[2] or m[3] or m[4] or "").lower()
        if m[5] or name == "role" and value.strip() in _ROLES or name == "aria-hidden" and value.strip() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id"):
            for word in value.split():
                if word in _MARKS or any(part in _MARKS for part in re.split(r"[-_:]+|(?<=[a-z])\d+", word)):
                    if not re.search(r"(?:article|post|entry|story|main|page)[-_]?(?:body|content|text|header|title)", word):
                        return True
    return False


def tokens(page: str) -> tuple[list[tuple[str, str, bool, bool, str]], bool]:
    """(kind, text, in the marked main part, in boilerplate, holder) of each tag and text run, and whether a main part is marked.

    Kind is ``t:`` and the tag, ``b`` for the end of a block, or ``w`` for text; the holder is the nearest block, cell or link around.
    """
    out: list[tuple[str, str, bool, bool, str]] = []
    stack: list[tuple[str, bool, bool, str]] = []
    at: dict[str, list[int]] = defaultdict(list)  # the places of each tag in the stack
    walls: list[int] = []  # those of the tags in _WALLS
    main = bad = found = False
    holder = ""

    def end(i: int) -> tuple[bool, bool, str]:
        """Close the element at place ``i`` and all in it; what held outside of it."""
        for tag, *_ in stack[i:]:
            at[tag].pop()
        while walls and walls[-1] >= i:
            walls.pop()
        _, main, bad, holder = stack[i]
        del stack[i:]
        return main, bad, holder

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            out.append(("w", html.unescape(text), main, bad, holder))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue  # comments, declarations and elements of raw text
        tag = tag.lower()
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        closing = bool(m["close"] or m["close2"])
        if tag in _BLOCKS:
            out.append(("b", "", main, bad, holder))
        elif tag in ("br", "td", "th"):
            out.append(("w", " ", main, bad, holder))
        if not closing:
            out.append(("t:" + tag, "", main, bad, holder))
            if tag in _VOID or attrs.endswith("/") and tag not in _BLOCKS:
                continue
            if tag in _ENDS and at["table"]:
                if open_ := [at[x][-1] for x in _ENDS[tag] if at[x] and at[x][-1] > at["table"][-1]]:
                    main, bad, holder = end(min(open_))
            else:  # without a table, cells end only what directly holds them
                ends = _ENDS.get(tag) or _ITEMS.get(tag, ())
                while walls and stack[walls[-1]][0] in ends:
                    main, bad, holder = end(walls[-1])
            if tag == "option" and stack and stack[-1][0] == tag:
                main, bad, holder = end(len(stack) - 1)
            if tag in _ENDS_P and at["p"] and at["p"][-1] > max((at[x][-1] for x in _HOLDS_P if at[x]), default=-1):
                main, bad, holder = end(at["p"][-1])
            at[tag].append(len(stack))
            if tag in _WALLS:
                walls.append(len(stack))
            stack.append((tag, main, bad, holder))
            if tag in _HOLDERS:
                holder = tag
            bad = bad or _marked(tag, attrs, main)
            if not bad and (tag in ("article", "main") or "articlebody" in attrs.lower()):
                main = found = True
        else:
            if at[tag]:
                main, bad, holder = end(at[tag][-1])
            out.append(("t:" + tag, "", main, bad, holder))
    out.append(("b", "", main, bad, holder))
    return out, found


def _type(kind: str, main: bool, bad: bool, found: bool, holder: str) -> str:
    if kind != "w":
        return "t:aside" if bad else "t:main" if main else kind if kind in _KNOWN else "t:other"
    return "w:aside" if bad else "w:main" if main else "w:out" if found else "w@" + holder


def _tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count: dict[str, list[int]] = {}
    for frame in frames:
        for page in frame.html:
            got, found = tokens(page or "")
            if found:
                for kind, text, main, bad, holder in got:
                    if kind != "b" and (n := len(text.split()) if kind == "w" else 1):
                        inside = main and not bad
                        for key in {_type(kind, main, bad, found, holder), _type(kind, False, False, False, holder), "w" if kind == "w" else ""} - {""}:
                            count.setdefault(key, [0, 0])[inside] += n
    yield pd.DataFrame([(k, *v) for k, v in count.items()], columns=["kind", "n_out", "n_in"])


def weights(pages: DataFrame) -> dict[str, float]:
    """Token weights from all pages that mark their main part; a tag that is no element of HTML is of one type with all such."""
    rows = pages.select(F.col("html").cast("string").alias("html")).mapInPandas(_tally, "kind string, n_out long, n_in long").groupBy("kind").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    n = {r.kind: (r.n_in, r.n_out) for r in rows.collect()}  # one row a type: words, and the elements of HTML
    return _weights(n)


def _weights(n: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights from how often each type is inside and outside of main parts."""
    all_in = sum(v[0] for k, v in n.items() if not k.startswith(("w:", "w@"))) + 1
    all_out = sum(v[1] for k, v in n.items() if not k.startswith(("w:", "w@"))) + 1
    odds = {k: math.log((a + 0.5) / (all_in + 1)) - math.log((b + 0.5) / (all_out + 1)) for k, (a, b) in n.items()}
    out = {k: min(-0.05, v) for k, v in odds.items() if k.startswith("t:")}
    word = min(max(odds.get("w", 0.7), 0.2), 3.0)
    out |= {"w": word, "w:main": max(word, min(odds.get("w:main", word), 6.0)), "w:out": max(-3.0, min(odds.get("w:out", -1.0), -word)), "w:aside": max(-0.05, min(odds.get("w:aside", -1.0), -0.01))}
    # words of each holder, drawn to all words by PRIOR of them; words always count for a page's text
    a, b = n.get("w", (0, 0))
    prior = PRIOR / (a + b + 1)
    out |= {k: max(LEAST * word, math.log((v[0] + prior * a + 0.5) / (all_in + 1)) - math.log((v[1] + prior * b + 0.5) / (all_out + 1))) for k, v in n.items() if k.startswith("w@")}
    # a marked main part is not cut by its lists, nor by what is dropped from it anyway
    return out | {"t:main": -0.01, "t:aside": -0.01}


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run ``lo:hi`` of the greatest sum, the first to end of such; empty where no sum is above 0."""
    best = total = 0.0
    at, lo, hi = 0, 0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, at = 0.0, i + 1
        elif total > best:
            best, lo, hi = total, at, i + 1
    return lo, hi


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The text of the best run of tokens; empty for null, for no words and for pages of boilerplate alone."""
    got, found = tokens(page or "")
    scores = []
    for kind, text, main, bad, holder in got:
        if kind == "w":
            n = len(text.split())
            scores.append(n * weight.get(_type(kind, main, bad, found, holder), weight["w"]) if n else 0.0)
        else:
            scores.append(weight.get(_type(kind, main, bad, found, holder), -0.1) if kind != "b" else 0.0)
    lo, hi = best_run(scores)
    blocks: list[str] = []
    block: list[str] = []
    for kind, text, _, bad, _ in [*got[lo:hi], ("b", "", False, False, "")]:
        if kind == "w" and not bad:
            block.append(text)
        elif kind == "b" and block:
            if line := " ".join("".join(block).split()):
                blocks.append(line)
            block = []
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (``page_id, url, html``): ``page_id, url, text, n_chars``.

    Null, empty and word-less html give an empty text; without any page that marks its main part, default weights
    hold; repeated rows are extracted each; an empty table gives no rows; other columns are not read.
    """
    weight = pages.sparkSession.sparkContext.broadcast(weights(pages))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [main_text(x, weight.value) for x in frame.pop("html")]
            frame["n_chars"] = frame.text.str.len().astype("int64")
            yield frame

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``, by ``extract``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
