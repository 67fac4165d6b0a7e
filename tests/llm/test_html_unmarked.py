"""The scan against brute force, and extraction where pages do not say what is their article."""

import itertools
import random
import re

import pytest

from memlake.llm.htmltext import best_run, extract, main_text, tokens, weights


def test_best_run_is_the_greatest():
    rnd = random.Random(4)
    for _ in range(400):
        scores = [float(rnd.choice([-8, -3, -1, 0, 1, 2, 7])) for _ in range(rnd.randint(0, 12))]
        lo, hi = best_run(scores)
        sums = [sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2)]
        assert sum(scores[lo:hi]) == max([0.0, *sums])


def unmarked(page: str, parts: str) -> str:
    page = re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)
    return re.sub(rf"<(/?)(?:{parts})\b", r"<\1div", page, flags=re.I)


@pytest.mark.parametrize("parts", ["article|main", "article|main|nav|header|footer|aside|form"])
def test_pages_without_marks_give_the_same_text(spark, parts):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weight, want = weights(pages), {r.page_id: r.text for r in extract(pages).collect()}
    wrong = [r.page_id for r in pages.collect() if main_text(unmarked(r.html, parts), weight) != want[r.page_id]]
    assert len(wrong) <= 0.01 * len(want)


def test_holders():
    got, found = tokens("<div>a<p>b <b>c</b><a href=x>d</a> e</div>f<table><tr><td>g</table>")
    assert not found and [(t.strip(), h) for k, t, _, _, h in got if k == "w" and t.strip()] == [("a", "div"), ("b", "p"), ("c", "p"), ("d", "a"), ("e", "p"), ("f", ""), ("g", "td")]
