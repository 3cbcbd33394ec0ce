"""Pages without an article element: all runs of text that belong together."""

import pytest

from skyroute.llm.main_text import main_text

PARA = lambda k, n=300: f"{k:04d} " + "word " * (n // 5 - 1)
MENU = "<div>" + "".join(f"<div><a href=/{k}>Menu entry {k}</a></div>" for k in range(30)) + "</div>"
ROWS = "\n".join(f"<li>item {k}</li>" for k in range(4))
LINKS = "\n".join(f"<li><a href=/{k}>see also part {k}</a></li>" for k in range(6))


def page(blocks):
    return f"<body>{MENU}<div id=content>\n" + "\n".join(blocks) + f"\n</div>{MENU}<div>Imprint of the publisher, with a line of address.</div></body>"


@pytest.mark.parametrize("tag", ["p", "div"])
def test_one_very_long_paragraph(tag):
    texts = [PARA(k, 5000 if k == 6 else 300) for k in range(13)]
    got = main_text(page(f"<{tag}>{t}</{tag}>" for t in texts))
    assert got == "\n\n".join(t.strip() for t in texts)


@pytest.mark.parametrize(("between", "items"), [(f"<ul>\n{ROWS}\n</ul>", [f"item {k}" for k in range(4)]), (f"<ul>\n{LINKS}\n</ul>", [f"see also part {k}" for k in range(6)])])
def test_lists_between_paragraphs(between, items):
    first, second = [PARA(k) for k in range(4)], [PARA(k) for k in range(4, 9)]
    got = main_text(page([*(f"<p>{t}</p>" for t in first), between, *(f"<p>{t}</p>" for t in second)]))
    assert got.split("\n\n") == [*(t.strip() for t in first), *items, *(t.strip() for t in second)]
    assert "Menu" not in got and "Imprint" not in got


def test_short_paragraphs_before_very_long_ones():
    texts = [PARA(k, 300 if k < 3 else 5000) for k in range(9)]
    assert main_text(page(f"<p>{t}</p>" for t in texts)) == "\n\n".join(t.strip() for t in texts)


BODY = "".join(f"<p>{PARA(k).strip()}</p>" for k in range(4))
TEXTS = [PARA(k).strip() for k in range(4)]


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "page with-sidebar", "share-price", "related-work", "content-sidebar-wrap", "modal overlay", "sidebar"])
def test_names_around_an_article(name):
    assert main_text(f"<body>{MENU}<div class='{name}'><article>{BODY}</article></div>{MENU}</body>").split("\n\n") == TEXTS


@pytest.mark.parametrize("name", ["share-price", "related-work", "alert", "alert alert-warning", "no-ads", "related", "promo-code-list", "commentary"])
def test_names_inside_an_article(name):
    box = f"<section class='{name}'><h2>A heading</h2><p>Some words in a box that belong to the text.</p></section>"
    assert main_text(f"<body>{MENU}<article>{BODY}{box}</article></body>").split("\n\n") == [*TEXTS, "A heading", "Some words in a box that belong to the text."]


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "site-sidebar", "comments", "comment-list", "related-posts", "share-buttons", "newsletter-signup", "main-nav"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_of_what_is_no_article(name, tag):
    links = "".join(f"<li><a href=/{k}>More to see, part {k}</a></li>" for k in range(5))
    words = "" if name in ("related-posts", "share-buttons") else "<p>Words that nobody wants to read here, whatever they say.</p>"
    box = f"<div class='{name}'>{words}<ul>{links}</ul></div>"
    assert main_text(f"<body>{MENU}{box}<{tag}>{BODY}{box}</{tag}>{box}</body>").split("\n\n") == TEXTS


@pytest.mark.parametrize("source", ["/root/testdata/sf0.001/pages.parquet", "/root/testdata/sf0.01/pages.parquet"])
def test_surge_and_dive_find_the_text_without_article_elements(source):
    """The given pages with their article elements renamed: the same text, whole."""
    import re

    import pyarrow.parquet as pq

    pages = [x for x in pq.read_table(source, columns=["html"]).column("html").to_pylist() if x]
    assert pages
    for x in pages:
        assert main_text(re.sub(r"(</?)(article|main)\b", r"\1div", x)) == main_text(x)


def test_short_ends_of_a_text():
    texts = ["Heading", *TEXTS, "The end."]
    blocks = ["<h1>Heading</h1>", BODY, "<p>The end.</p>"]
    assert main_text(page(blocks)).split("\n\n") == texts
    assert main_text(f"<body><nav>{MENU}</nav>{''.join(blocks)}<footer>Imprint</footer></body>").split("\n\n") == texts


def test_deep_nesting_in_bounded_memory():
    """A hundred thousand open elements: what is kept for each line does not grow with the depth."""
    import tracemalloc

    text = "some words of text " * 10
    tracemalloc.start()
    assert main_text("<div>" * 100_000 + f"<p>{text}</p>" + "</div>" * 100_000) == text.strip()
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    lines = [f"line {i} of text that is long enough" for i in range(20_000)]
    assert main_text("".join(f"<div><p>{x}</p>" for x in lines)).split("\n\n") == lines


def test_formulas_stay():
    assert main_text(f"<article><p>{'words ' * 20}<math><mi>x</mi></math> is meant</p></article>").endswith("x is meant")
