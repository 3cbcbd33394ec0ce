import re
from html import unescape

import pytest

from skyroute.llm.main_text import extract_main_text, main_text
from skyroute.llm.quotations import linked_conversations

SF = "/root/testdata/sf0.001"


def plain(page):
    """The article of the given pages, by their known structure."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.DOTALL)[1]
    blocks = [" ".join(unescape(re.sub(r"</?b>|<[^>]*$", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


def test_main_text_of_whole_table(spark):
    from skyroute.llm.queries import op10_main_text

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op10_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


LONG = "Many words of the article stand here, one after the other, so that the sum is large. " * 3

PAGES = [
    (None, ""), ("", ""), ("no markup at all", "no markup at all"), ("<p>short", "short"),
    (f"<nav><a href=x>Home</a></nav><div id='content'><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><p>Ok.</p></div><div class='sidebar'>{LONG}</div><footer>{LONG}</footer>",
     f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}\n\nOk."),
    (f"<header><p>{LONG}</p></header><article><header><h1>T &amp;&nbsp;&#x55;</h1></header><p>a<b>b</b>\n c</p><aside>{LONG}</aside><p>{LONG}<form>{LONG}</form></article>"
     f"<section class='comments'><article><p>{LONG * 4}</p></article></section>", f"T & U\n\nab c\n\n{LONG.strip()}"),
    (f"<article><p>{LONG}<script>if (a < b) {{ '</p>' }}</script><style>p > a {{}}</style><!-- <p>no</p> --></p><div class=\"ad-box ad\">{LONG}</div><p>end</p></article>", f"{LONG.strip()}\n\nend"),
    (f"<article><p title='a > b'>{LONG}<li>one<li>two</article", f"{LONG.strip()}\n\none\n\ntwo"),
    (f"<article><div class='cookie-notice'>never closed</article><article><p>{LONG}</p></article>", LONG.strip()),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text_cases(page, text):
    assert main_text(page) == text


def test_main_text_without_semantic_markup():
    """Only the distribution of text over lines tells the article from the menus."""
    menu = "<div>" + "".join(f"<div><a href=/{k}>Item {k}</a></div>" for k in range(30)) + "</div>"
    got = main_text(f"<body>{menu}{''.join(f'<div>{LONG}{k}</div>' for k in range(5))}{menu}</body>")
    assert all(f"{LONG}{k}" in got for k in range(5)) and "Item 3" not in got


def test_main_text_table_cases(spark):
    df = spark.createDataFrame([(1, "u", PAGES[4][0], 1), (1, "u", PAGES[4][0], 2), (2, None, None, 3), (3, "u", f"<article><p>{'word ' * 200_000}</p></article>", 4)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id, r.n_chars) for r in extract_main_text(df).collect())
    assert got == [(1, len(PAGES[4][1])), (1, len(PAGES[4][1])), (2, 0), (3, 999_999)]
    assert extract_main_text(df.limit(0)).count() == 0


CHAT = [
    (1, 0, "user", "How do I sort a list?\nAnd how do I reverse it?"),
    (1, 1, "assistant", "Use sorted() for that.\n\nFor the other, use reversed()."),
    (1, 2, "user", "Thanks, that works."),
    (1, 3, "user", "On Monday the helper wrote:\n> Use sorted() for that.\nDoes it copy?"),
    (1, 4, "assistant", "> Does it COPY?\n>> Use sorted() for that.\nYes, it does."),
    (1, 5, "user", "> something nobody said\nReally?"),
    (1, 6, "assistant", "  > And how do I  reverse it\nSlices work, too."),
    (2, 0, "user", "> Use sorted() for that.\nQuoted from elsewhere"),
    (2, 1, "user", None),
]


def chat(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, parent_turn int")
    return {(r.conv_id, r.turn): r for r in linked_conversations(df).collect()}


def test_quotations_are_linked_and_cut_out(spark):
    got = chat(spark, CHAT)
    assert len(got) == len(CHAT)
    assert {k: r.parent_turn for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 3, (1, 5): 4, (1, 6): 0, (2, 0): None, (2, 1): 0}
    assert got[1, 3].text == "Does it copy?" and got[1, 4].text == "Yes, it does." and got[1, 6].text == "Slices work, too." and got[2, 1].text == ""
    assert (got[1, 4].n_quotes, got[1, 4].n_linked) == (2, 2) and (got[1, 5].n_quotes, got[1, 5].n_linked) == (1, 0) and got[2, 0].n_linked == 0
    assert {k: r.branch for k, r in got.items() if r.depth} == {(1, 3): [3], (1, 4): [3], (1, 5): [3], (1, 6): [6]}


def test_reply_order(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    order = [r.turn for r in linked_conversations(df).collect() if r.conv_id == 1]
    place = {t: k for k, t in enumerate(order)}
    assert order[0] == 0 and place[3] < place[4] < place[5] and place[1] < place[3]


def test_chat_tables(spark):
    assert chat(spark, []) == {}
    long = [(7, t, "user", f"message {t}" if t != 2600 else "> message 10\nback to it") for t in range(0, 3000, 2)]
    got = chat(spark, long + [(7, 10, "a", "another at the same turn"), (None, 1, "user", "lost"), (8, None, "user", "lost")])
    assert len(got) == 1500 and got[7, 2].parent_turn == 0 and got[7, 2048].parent_turn == 2046
    assert got[7, 2600].parent_turn == (2598 if got[7, 10].text != "message 10" else 10)
    nested = [(3, 0, "user", "first thing")] + [(3, t, "user", f"> {'first thing' if t == 1 else f'reply {t - 2}'}\nreply {t}") for t in range(1, 9)]
    deep = chat(spark, nested)
    assert deep[3, 8].parent_turn == 6 and deep[3, 8].branch[-1] == 8


def test_no_quotations_in_whole_table(spark):
    from skyroute.llm.queries import op4_quotation_linking

    rows = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = op4_quotation_linking(spark, SF).collect()
    assert {(r.conv_id, r.turn): r.text for r in got} == {k: t or "" for k, t in rows.items()}


def test_marks_and_blanks_without_end(spark):
    marks, blanks, n = "> " * 1_000_000, " " * 1_000_000, 1_000_000
    rows = [
        (1, 0, "user", f"first{blanks}words"), (1, 1, "user", f"{marks}first words\nmore"), (1, 2, "user", f"wrote:{blanks}x\n> more\n{blanks}y{blanks}"),
        (1, 3, "user", ">" * n), (1, 4, "user", "\n\r\n as it is\r\n \t"), (1, 5, "user", "> as it is\n\n\nyes \n \t"), (1, 6, "user", "one\rtwo"), (1, 7, "user", "> two\nok"),
    ]
    got = chat(spark, rows)
    assert {k[1]: (r.text, r.n_quotes, r.parent_turn) for k, r in got.items()} == {
        0: (rows[0][3], 0, None), 1: ("more", 1, 0), 2: (f"wrote:{blanks}x\n{blanks}y", 1, 1), 3: ("", 1, 2), 4: (rows[4][3], 0, 3), 5: ("yes", 1, 4), 6: ("one\rtwo", 0, 5), 7: ("ok", 1, 6),
    }
