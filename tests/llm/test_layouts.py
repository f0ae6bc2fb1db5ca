"""Main text of pages whose sites write their paragraphs in other elements than the tables' pages do."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import html_text

PARTS = [
    "The river rose by two metres overnight, and the old bridge was closed to all traffic before dawn, the council said on Monday morning.",
    "Engineers who had inspected the piers in spring found cracks in the masonry; repairs, they wrote, could wait until the autumn at the latest.",
    "Residents of the lower town, many of whom had spent the night in the school, were told that they could return to their houses by the evening.",
]
MENU = "<div class='x1'><a href='/a'>Home</a></div><div class='x1'><a href='/b'>World</a></div><div class='x1'><a href='/c'>Sport</a></div>"
NOTICE = "<div id='cookie-consent'>We use cookies to improve your visit, to measure what is read, and to show you offers. Read our policy for more about the choices you have.</div>"


@pytest.fixture(scope="module")
def fitted(spark):
    """The weights that the query's own table of the tests gives."""
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def lines(page, weights):
    return html_text.main_text(page, weights).split("\n")


@pytest.mark.parametrize(
    "article",
    [
        "".join(f"<div>{p}</div>" for p in PARTS),
        "<div>" + "".join(f"<div>{p}</div>" for p in PARTS) + "</div>",
        "<table><tr><td>" + "</td></tr><tr><td>".join(PARTS) + "</td></tr></table>",
        "<section>" + "".join(f"<p>{p}</p>" for p in PARTS) + "</section>",
        "<article>" + "".join(f"<div><span>{p}</span></div>" for p in PARTS) + "</article>",
        "<br><br>".join(f"<div>{p}</div>" for p in PARTS),
    ],
    ids=["divs", "nested divs", "table cells", "section", "article of divs", "breaks"],
)
@pytest.mark.parametrize("prior", [False, True])
def test_articles_of_other_elements(fitted, article, prior):
    page = f"<html><body>{MENU}{article}{NOTICE}<div class='comments'><div>{PARTS[0]}</div></div></body></html>"
    assert lines(page, html_text.START if prior else fitted) == PARTS


def test_what_is_marked_as_boilerplate_stays_out_however_long_it_is(fitted):
    long = "".join(f"<p>{p}</p>" for p in PARTS[1:])
    article = "<div>" + "".join(f"<p>{p}</p>" for p in PARTS) + "</div>"
    for around in ("<header>{}</header>", "<div id='discussion'>{}</div>", "<div class='related-content'>{}</div>", "<footer>{}</footer>", "<aside>{}</aside>", "<form>{}</form>"):
        page = f"<html><body>{around.format(long)}{MENU}{article}</body></html>"
        assert lines(page, fitted) == PARTS, around


def test_a_page_of_one_short_text_is_not_empty(fitted):
    text = "One long line of plain text, without any mark of what it is, which is all that this page has to say to those who come across it, and no more."
    assert lines(f"<div>{text}</div>", fitted) == [text] and lines(text, fitted) == [text]
    assert lines(f"<html><body>{MENU}</body></html>", fitted) == [""]
    # Marked boilerplate makes no page's text, even where there is nothing else.
    assert lines(f"<html><body>{NOTICE}{MENU}</body></html>", fitted) == [""]


def test_edges_decide_on_some_pages(fitted):
    """The cut keeps a short line between paragraphs whose own odds are against it."""
    page = html_text.Page(f"<html><body>{MENU}<div><div>{PARTS[0]}</div><div><a href='/x'>See</a> the map</div><div>{PARTS[1]}</div><div>{PARTS[2]}</div></div></body></html>")
    odds = np.clip(page.features() @ fitted, -6, 6)
    short = page.texts.index("See the map")
    assert odds[short] < 0 and "See the map" in page.text(fitted).split("\n")


def test_kind_of_element_is_no_classifier(fitted):
    w = dict(zip(html_text.FEATURES, fitted, strict=True))
    assert abs(w["paragraph"]) < w["length"] * 1.5 and w["bias"] + 1.0 * w["length"] + w["sentence"] > 0
    assert all(w[k] < -w["length"] for k in html_text.FEATURES[: html_text.MARKUP] if k not in html_text.CONTENT)
