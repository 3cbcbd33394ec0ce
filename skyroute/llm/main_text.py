"""Main text of web pages by line-block distribution.

Markup is stripped into *lines*, one for each stretch between block-level tags, blank ones included.  The
text lengths (link text left out) are summed over sliding windows of ``WINDOW`` lines.  A line where the sum
surges over the threshold, the same for all pages, opens a run, and the line where it dives back closes it.  Runs that belong
together are joined with all that is between them: those with few characters of links between, or in one parent block with
less of them than text in either run.  The joined run with the most text is the main text; an article or main element around a run doubles its weight.

Windows cut short first and last lines, such as headings, so both ends are then moved on inside the lowest block that holds the run: over
lines that are headings or of the run's kind and not mostly links, or to the ends of the block if it is an article or main element.

Scripts, styles, navigation, forms, asides and footers are dropped as markup before anything is counted, and so are elements
with a class, id or role that names, as a whole, an advert, a menu, comments or the like; not those around all articles.  Names that may
also stand for text (``SOFT``) only count outside articles; inside, lines of such elements go if they are mostly links.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyroute.llm import words as W

WINDOW = 3
#: Window sum in characters from which a run counts as text; not a share of the page's sums, as long lines would hide shorter ones.
SURGE_LEAST = 40

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements that end a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is no text of the article.
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog footer form head iframe map menu nav noscript object picture select svg template video".split()
)
#: Elements whose content is not parsed.
_RAW = "script|style|textarea|title|xmp"
#: Names in a class, id or role of what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors cookie cookies consent gdpr notice notices popup newsletter subscribe "
    "subscription signup login sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar complementary contentinfo".split()
)
#: Names of readers' comments, each of which may be an article element.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Names that may also stand for text of the article.
SOFT = frozenset("alert alerts modal overlay promo promos promotion promotions search share sharing social related recommended recommendations side".split())
#: Words that say where or how much, and leave a name what it is.
NEUTRAL = frozenset(
    "area articles bar block bottom box button buttons global group header icons item items left links list lower main media module page post posts primary reader right row "
    "secondary section site slot stories text top topics unit upper user".split()
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)((?:(?>"[^"<]*"|'[^'<]*'|[^>]))*+)(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
#: Elements that an open p, li, … does not outlive, so that an unclosed one does not swallow the rest.
_SHORT = frozenset("p li dt dd td th option span a b i em strong small label h1 h2 h3 h4 h5 h6".split())


def _names(attributes: str, marks: frozenset) -> bool:
    """Whether a whole name of a class, id or role is a mark, or of marks and neutral words only."""
    if "=" not in attributes:
        return False
    for m in _NAMED.finditer(attributes):
        for name in next(filter(None, m.groups()), "").lower().split():
            words = [x for x in re.split(r"[-_]+", name) if x]
            if any(x in marks for x in words) and all(x in marks or x in NEUTRAL for x in words):
                return True
    return False


#: Blocks that hold text and no other part of a page.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption legend summary address hr option".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block:
    """A block that is no leaf, by its place in the page; the lines in it are one after the other."""

    __slots__ = ("token", "outer", "article", "first", "stop")

    def __init__(self, token: int, outer: Block | None, is_article: bool, first: int):
        self.token, self.outer = token, outer
        #: the outermost article or main element of this block and those around it
        self.article: Block | None = outer.article if outer is not None and outer.article is not None else self if is_article else None
        self.first, self.stop = first, 1 << 62

    def holds(self, line: int) -> bool:
        return self.first <= line < self.stop


class Line(NamedTuple):
    text: str
    size: int  #: characters outside links
    block: Block | None  #: the innermost block around it that is no leaf; none is the body
    tag: str  #: the block that it begins or goes on in; empty behind the end of one
    parent: int  #: the block around its own, -1 for the body


def lines(page: str) -> list[Line]:
    """The lines of a page.  Time and memory follow its length, however deep its elements are nested."""
    tokens = list(_TOKEN.finditer(page))
    ends: dict[int, int] = {}  # token of an element's end tag, for each start tag
    starts: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    articles = []
    for k, t in enumerate(tokens):
        tag = (t[3] or "").lower()
        if not tag or tag in VOID:
            continue
        if t[2]:
            if own := opened.get(tag):
                starts[k] = own.pop()
                ends[starts[k]] = k
        elif not t[4].endswith("/"):
            opened.setdefault(tag, []).append(k)
            if tag in ("article", "main"):
                articles.append(k)
    out: list[Line] = []
    text, linked, link, own_tag = [], 0, 0, ""
    at, k, soft = 0, 0, -1  # soft: the end tag of the outermost element with a soft name in an article
    around: Block | None = None  # the innermost block that is open and will be closed; html, body and leaves don't count
    within = set(articles)

    def flush():
        nonlocal text, linked
        line = " ".join(entities.unescape("".join(text)).split())
        size = max(0, len(line) - linked)
        if not (soft >= 0 and size * 2 < len(line)):
            parent = around if own_tag in LEAF or not own_tag or around is None else around.outer
            out.append(Line(line, size, around, own_tag, -1 if parent is None else parent.token))
        text, linked = [], 0

    def dropped(tag: str, attributes: str, at: int) -> bool:
        nonlocal soft
        inside = around is not None and around.article is not None
        if tag in DROPPED or tag == "header" and not inside:
            return True
        if tag in ("html", "body", "main", "article") or "=" not in attributes:
            return False
        if _names(attributes, COMMENTS):
            return True
        if articles and at < articles[0] and articles[-1] < ends.get(at, at):  # around all articles
            return False
        if _names(attributes, MARKS | COMMENTS):
            return True
        if soft < 0 and _names(attributes, SOFT | MARKS | COMMENTS):
            if not inside:
                return True
            soft = ends.get(at, -1)
        return False

    while k < len(tokens):
        t = tokens[k]
        if t.start() > at:
            piece = page[at : t.start()]
            text.append(piece)
            linked += len(piece) if link else 0
        at = t.end()
        tag, closing = (t[3] or "").lower(), bool(t[2])
        k += 1
        if not tag:
            continue
        if not closing and tag not in VOID and (tag in BLOCK or tag in DROPPED or t[4]):
            before = soft
            gone = dropped(tag, t[4], k - 1)
            if gone or soft != before:
                now, soft = soft, before
                flush()
                soft = now
        else:
            gone = False
        if gone:
            stop = ends.get(k - 1)
            if stop is None:  # never closed: up to the next block, or the article
                short = tag in _SHORT
                stop = next((j for j in range(k, len(tokens)) if (tokens[j][3] or "").lower() in (BLOCK if short else ("article", "main"))), len(tokens))
                at = tokens[stop].start() if stop < len(tokens) else len(page)
                k = stop
            else:
                at, k = tokens[stop].end(), stop + 1
            continue
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        if tag in BLOCK:
            flush()
            link = 0
            own_tag = "" if closing else tag
            if tag not in ("html", "body") and tag not in LEAF:
                if not closing and k - 1 in ends:
                    around = Block(k - 1, around, k - 1 in within, len(out))
                elif closing and k - 1 in starts:
                    while around is not None and around.token >= starts[k - 1]:
                        around.stop = len(out)
                        around = around.outer
        if k - 1 == soft:
            flush()
            soft = -1
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def _joined(found: list[Line], runs: list[tuple[int, int]], sizes: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs, with their last windows, those that belong together as one."""
    links = np.array([len(x.text) for x in found], dtype=np.int64) - sizes
    blocks = lambda a, b: {x.parent for x in found[a:b] if x.size} - {-1}
    out: list[tuple[int, int]] = []
    last = (0, 0)  # the last run's own lines, up to the end of its last window
    for own, b in runs:
        a, reach = own, min(b + WINDOW - 1, len(found))
        text = int(sizes[a:reach].sum())
        if out:
            between = slice(last[1], max(last[1], a))
            linked = int(links[between].sum())
            near = blocks(*last) & blocks(a, reach) and linked <= min(text, int(sizes[slice(*last)].sum()))
            if near or linked <= max(SURGE_LEAST, int(sizes[between].sum())):
                a = out.pop()[0]
        out.append((a, reach))
        last = (own, reach)
    return out


def _moved(found: list[Line], start: int, stop: int) -> tuple[int, int]:
    """A run's ends, moved on inside the lowest block that holds it."""
    own = [k for k in range(start, stop) if found[k].size]
    block = found[own[0]].block
    while block is not None and not block.holds(own[-1]):
        block = block.outer
    if len(own) == 1 and found[own[0]].tag not in LEAF and block is not None:
        block = block.outer
    in_article = block is not None and block.article is not None
    if in_article:
        block = block.article
    kinds = {found[k].tag for k in own} | _HEADINGS
    within = lambda k: block is None or block.holds(k)

    def goes_on(k: int) -> bool:
        x = found[k]
        if not within(k):
            return False
        return in_article or not x.text or (x.tag in kinds and x.size * 2 >= len(x.text) and x.parent == (-1 if block is None else block.token))

    while start and goes_on(start - 1):
        start -= 1
    while stop < len(found) and goes_on(stop):
        stop += 1
    if in_article:  # a window may begin or end outside the article
        while start < stop and not within(start):
            start += 1
        while stop > start and not within(stop - 1):
            stop -= 1
    return start, stop


def main_text(page: str | None) -> str:
    """The main text: its blocks joined by two line ends; empty if there is none."""
    found = lines(page or "")
    sizes = np.array([x.size for x in found], dtype=np.int64)
    sums = np.convolve(sizes, np.ones(WINDOW, dtype=np.int64))[WINDOW - 1 :]  # of each line and those after it
    high = sums >= SURGE_LEAST
    edges = np.flatnonzero(np.r_[True, high[1:] != high[:-1], True])
    runs = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if high[a]]
    if runs:
        # a run does not go on across the edge of an article
        inside = [-1 if x.block is None or x.block.article is None else x.block.article.token for x in found]
        runs = [part for a, b in runs for part in _cut(inside, a, min(b + WINDOW - 1, len(found)))]
        weight = lambda r: int(sizes[r[0] : r[1]].sum()) * (2 if inside[r[0]] >= 0 else 1)
        by_article: dict[int, list[tuple[int, int]]] = {}
        for r in runs:
            by_article.setdefault(inside[r[0]], []).append((r[0], max(r[0] + 1, r[1] - WINDOW + 1)))
        joined = [r for own in by_article.values() for r in (_joined(found, own, sizes) if inside[own[0][0]] < 0 else [(own[0][0], min(own[-1][1] + WINDOW - 1, len(found)))])]
        start, stop = _moved(found, *max(joined, key=lambda r: (weight(r), -r[0])))
        chosen = [x.text for x in found[start:stop]]
    else:
        in_article = [x.text for x in found if x.block is not None and x.block.article is not None]
        chosen = in_article if any(in_article) else [x.text for x in found if x.size]
    return "\n\n".join(x for x in chosen if x)


def _cut(inside: list[int], start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Parts of a run of lines inside the same article, or outside all."""
    at = start
    for k in range(start + 1, stop + 1):
        if k == stop or inside[k] != inside[at]:
            yield at, k
            at = k


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars, its number of code points.

    A null or empty html has an empty text.  Character references are decoded, white space inside a
    block becomes one space, and blocks are joined by two line ends; nothing else is cut.  Repeated rows
    each give a row; an empty table gives an empty one; other columns are ignored, whatever their names.
    """

    def run(batches):
        for batch in batches:
            for chunk in W.chunks(batch, "html"):
                texts = [main_text(x) for x in chunk.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), chunk.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(run, SCHEMA)
