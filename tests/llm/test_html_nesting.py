import pytest

from memlake.llm.htmltext import main_text, weights

ROWS = {"table": "<tr><td>x", "dl": "<dt>x<dd>y", "ul": "<li><p>x", "div": "<p><b>x", "section": "<i>x "}
WORDS = "These are the words of the article and they are kept."


@pytest.mark.parametrize("tag", ROWS)
@pytest.mark.parametrize("box", ["<nav>", "<div class='sidebar'>"])
def test_rows_without_end_tags_before_and_in_the_article(spark, tag, box):
    w = weights(spark.createDataFrame([], "html string"))
    rows = f"<{tag}>" + ROWS[tag] * 400 + f"</{tag}>"
    page = f"<html><body>{box}{rows}</{box[1:4]}><article><p>{WORDS}</p>{{}}</article><footer><p>no</p></footer><p>no no no</p></body></html>"
    assert main_text(page.format(""), w) == WORDS
    text = main_text(page.format(rows), w)
    assert text.startswith(WORDS) and "no" not in text.split() and text.split().count("x") == 400


def test_implied_end_tags(spark):
    w = weights(spark.createDataFrame([], "html string"))
    page = "<article><p>One.</p><ul><li class=ad><b>Buy<p>now<li>Two.</ul><table><tr><td class=ad><ul><li>Buy<td>Three.<tr class=ad><td>Buy<tr><td>Four.</table><dl><dt class=ad>Buy<dd><div>Five.<dt>Six.</dl><p class=ad><i>Buy<div>Seven.</div></article>"
    assert main_text(page, w).split() == "One. Two. Three. Four. Five. Six. Seven.".split()
    nested = "<article><ul><li class=ad>Buy<ul><li>now</ul>more</li><li>One.</ul><table><tr><td><table><tr><td class=ad>Buy</table>Two.</table></article>"
    assert main_text(nested, w).split() == ["One.", "Two."]
