"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat text blocks at its block-level tags.  A block's features are its word
count and link density, those of its two neighbours (Kohlschütter et al. 2010), whether it
is a heading, and what its surroundings are called: the nearest named container (article,
main, navigation, advert, ...) and how many containers around it hold something else than
an article.  A small labelled table trains a decision tree; the fitted tree becomes a column
expression, so classification runs next to the scan, without a shuffle and without moving
blocks between pages.

Scripts, styles, comments, form controls and the head never become blocks.  Character
references are decoded, white space inside a block becomes one blank, the blocks kept are
joined by one blank in page order.  What is left open costs only itself: an element of that
kind that is never closed loses its text up to the next block (raw text, as in browsers, up to
the page's end), and a ``p`` or ``li`` ends where the next one starts.

Defined results: a null, empty or text-free page gives the empty text; rows are handled one
by one, so repeated rows and null or repeated ids give a row each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = (
    "words", "link_density", "prev_words", "prev_density", "next_words", "next_density", "heading", "nearest", "foreign",
)
MAX_TRAINING_ROWS = 10_000
MAX_DEPTH = 6

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_UNQUOTED = re.compile(r"[^<>\"']*")
_HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements whose content is no text of the page; the first four hold raw text, which only their
# end tag ends.
_RAW = frozenset("script style textarea title".split())
_OPAQUE = _RAW | frozenset(
    "head noscript template svg iframe object canvas select button option datalist annotation annotation-xml".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    # formulas
    "math mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts mtable mtr mtd mpadded mphantom menclose mfenced merror semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag may be left out, and the tags that then end them; any block ends a p.
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FOREIGN_TAGS = frozenset("nav footer aside form menu dialog".split())
_MAIN_TAGS = frozenset("article main".split())
_FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer sidebar side aside cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe signup login social share sharing related recommended recommendations "
    "comment comments reply replies disqus respond widget toolbar pagination pager copyright legal disclaimer "
    "contentinfo complementary search tags form".split()
)
_MAIN_WORDS = frozenset("article main content post entry story body text".split())
_LAYOUT_WORDS = frozenset("layout wrapper container page has with no outer grid row col column".split())


def _kind(tag: str, attributes: str) -> int:
    """What a container holds by its tag and names: 1 main text, -1 something else, 0 unknown."""
    words: set[str] = set()
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            words.update(w.lower() for w in _NAME_WORD.findall(m[2] or m[3] or m[4] or ""))
    if words & _FOREIGN_WORDS and not words & _LAYOUT_WORDS and not ("header" in words and words & {"article", "post", "entry"}):
        return -1
    if tag in _FOREIGN_TAGS:
        return -1
    if tag in _MAIN_TAGS or words & _MAIN_WORDS and not words & _LAYOUT_WORDS:
        return 1
    return 0


class Markup:
    """Forward scan of a page for its tags.  What is not found once is not looked for again, so
    the scan takes time in proportion to the page, whatever is left open in it."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()
        self.ends: dict[str, dict[int, int]] = {}
        # places outside of quotes from which no tag ends before another quote or tag opens
        self.dead: set[int] = set()

    def find(self, what: str, at: int) -> int:
        """Where ``what`` comes next, -1 if not."""
        if what in self.missing:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.missing.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """Position of the ``>`` that ends the tag whose name ends at ``at``: the first one outside
        of quotes, or the first one of all where a quote or another tag comes between; or -1."""
        first = self.find(">", at)
        k, passed = at, []
        while first >= 0 and k not in self.dead:
            passed.append(k)
            k = _UNQUOTED.match(self.page, k).end()
            c = self.page[k : k + 1]
            if c == ">":
                return k
            if c not in ('"', "'"):
                break
            k = self.find(c, k + 1) + 1
            if not k:
                break
        self.dead.update(passed)
        return first

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next tag from ``at`` on; comments and
        declarations have no name.  A ``<`` that no ``>`` follows is text."""
        while m := _MARKUP.search(self.page, at):
            if m[2]:
                end = self.tag_end(m.end())
                if end >= 0:
                    return m.start(), end + 1, m[2].lower(), bool(m[1]), self.page[m.end() : end]
            elif m[0] == "<!--":
                end = self.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(self.page), "", False, ""
            else:
                end = self.find("]]>", m.end()) + 2 if m[0] == "<![CDATA[" else 1
                end = end if end > 1 else self.find(">", m.end())
                if end >= 0:
                    return m.start(), end + 1, "", False, ""
            at = m.end()
        return None

    def element_end(self, tag: str, at: int) -> int:
        """End of the element whose start tag ends at ``at``, -1 if it is never closed.  Raw text
        goes to the page's end then; a head ends where the body starts."""
        if tag in _RAW:
            m = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(self.page, at)
            return m.end() if m else len(self.page)
        if tag == "head":
            m = "</head" not in self.missing and _HEAD_END.search(self.page, at)
            if m:
                return m.end()
            self.missing.add("</head")
            return -1
        if tag not in self.ends:
            self.ends[tag] = self._pairs(tag)
        return self.ends[tag].get(at, -1)

    def _pairs(self, tag: str) -> dict[int, int]:
        """For every start tag with an end tag of its own: where the two end."""
        ends: dict[int, int] = {}
        opened: list[int] = []
        end = 0
        for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", self.page, re.IGNORECASE):
            if m.start() < end:
                continue
            end = self.tag_end(m.end())
            if end < 0:
                break
            if not m[1]:
                if self.page[end - 1] != "/":
                    opened.append(end + 1)
            elif opened:
                ends[opened.pop()] = end + 1
        return ends


def text_blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, features) of the page's blocks in order."""
    blocks: list[tuple[str, int, int, int, int, int]] = []
    # Open containers: tag, kind of the nearest one that has a kind, how many hold something else
    # than main text, how many hold main text.
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = heading = 0
    # inside of an opaque element that is never closed: its text goes up to the next block
    muted = False
    at = 0
    markup = Markup(page)

    def flush() -> None:
        nonlocal parts, link_parts, muted
        if parts:
            raw = "".join(parts)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                linked = len(" ".join(link_parts).split())
                blocks.append((text, len(text.split()), linked, heading, *stack[-1][1:3]))
        parts, link_parts, muted = [], [], False

    def add(text: str) -> None:
        if muted:
            return
        parts.append(text)
        if in_link:
            link_parts.append(text)

    def push(tag: str, kind: int) -> None:
        _, nearest, foreign, main = stack[-1]
        stack.append((tag, kind or nearest, foreign + (kind == -1), main + (kind == 1)))
        opened[tag] += 1

    def close(tag: str) -> None:
        while opened[tag]:
            top = stack.pop()[0]
            opened[top] -= 1
            if top == tag:
                break

    while found := markup.next(at):
        start, end, tag, closing, attributes = found
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in _OPAQUE:
            if not closing and not attributes.rstrip().endswith("/"):
                stop = markup.element_end(tag, at)
                if stop >= 0:
                    at = stop
                elif tag == "head":
                    flush()
                else:
                    muted = True
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in _INLINE:
            continue
        flush()
        if tag in _VOID:
            continue
        in_link = 0
        if tag in _HEADINGS:
            heading = 0 if closing else 1
        if tag in ("html", "body"):
            continue
        if closing:
            close(tag)
            continue
        if stack[-1][0] == "p":
            close("p")
        while tag in _CLOSED_BY.get(stack[-1][0], ()):
            close(stack[-1][0])
        if tag not in ("p", "li", "dd", "dt", "tr", "td", "th") and tag not in _HEADINGS:
            kind = _kind(tag, attributes)
            if tag == "header" and not kind and not stack[-1][3]:
                kind = -1
            push(tag, kind)
        elif attributes and _kind(tag, attributes) == -1:
            push(tag, -1)
    add(page[at:])
    flush()
    out = []
    for i, (text, n, linked, head, nearest, foreign) in enumerate(blocks):
        before = blocks[i - 1] if i else ("", 0, 0)
        after = blocks[i + 1] if i + 1 < len(blocks) else ("", 0, 0)
        shape = [v for b in ((text, n, linked), before, after) for v in (float(b[1]), b[2] / b[1] if b[1] else 0.0)]
        out.append((text, [*shape, float(head), float(nearest), float(min(foreign, 3))]))
    return out


_BLOCKS = "array<struct<text:string,f:array<double>>>"


def page_blocks(pages: DataFrame, carry: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``carry`` and ``blocks`` (text and features) of every page."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

    block_type = ArrayType(StructType().add("text", StringType()).add("f", ArrayType(DoubleType())))
    source = pages.select(*[F.col(c) for c in carry], F.col(html_col).alias("__html"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [
                    [{"text": t, "f": f} for t, f in text_blocks(h.as_py() or "")] for h in part.column(len(carry))
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(carry)], pa.array(found, to_arrow_type(block_type))], [*carry, "blocks"]
                )

    from pyspark.sql.types import StructField

    schema = StructType([*source.schema.fields[: len(carry)], StructField("blocks", block_type)])
    return source.mapInArrow(run, schema)


def labelled_blocks() -> list[tuple[list[float], float]]:
    """The labelled table: (features, 1.0 for main text) of the blocks of hand-made pages.

    A page is a list of (label, html); labels are repeated for every block the html gives."""
    rows = []
    for page in _LABELLED_PAGES:
        feats = [f for _, f in text_blocks("".join(h for _, h in page))]
        labels = [y for y, h in page for _ in text_blocks(h)]
        if len(feats) != len(labels):
            raise ValueError("a labelled page gives other blocks than its parts")
        rows += list(zip(feats, map(float, labels)))
    return rows


_LONG = "The committee met on Tuesday and agreed, after a long debate, to repair the old bridge before winter comes."
_SHORT = "It rained."
_MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "About us"))
# 1: main text, 0: anything else.  Containers appear with and without names, with long and
# short blocks on either side, so that the tree has to weigh surroundings, length and links.
_LABELLED_PAGES: list[list[tuple[int, str]]] = [
    [(0, f"<nav><ul>{_MENU}</ul></nav>"), (1, f"<article><h1>Bridge to be repaired</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p></article>"), (0, "<footer>&copy; 2020 Example</footer>")],
    [(0, f"<header><p>The Daily Example</p><p>{_LONG}</p></header>"), (1, f"<main><p>{_LONG}</p><p>{_SHORT}</p></main>"), (0, f"<aside><p>{_LONG}</p><p>Buy now</p></aside>")],
    [(0, f'<div class="ad"><p>{_LONG}</p></div>'), (1, f"<article><p>{_LONG} {_LONG}</p><h2>Costs</h2><p>{_LONG}</p></article>"), (0, f'<div class="comments"><p>{_LONG}</p><p>{_SHORT}</p></div>')],
    [(0, f'<div id="cookie-notice"><p>{_LONG}</p></div>'), (1, f'<div class="content"><p>{_SHORT}</p><p>{_LONG}</p></div>'), (0, f'<div class="sidebar"><p>{_LONG} {_LONG}</p></div>')],
    [(0, f"<div><ul>{_MENU}</ul></div>"), (1, f"<div><p>{_LONG}</p><p>{_LONG} {_LONG}</p><p>{_LONG}</p></div>"), (0, '<div><a href="/a">Imprint</a> <a href="/b">Contact</a></div>')],
    [(0, '<p><a href="/">Home</a> | <a href="/x">Archive</a></p>'), (1, f"<p>{_LONG}</p><p>{_LONG} <a href='/r'>report</a></p><p>{_LONG}</p>"), (0, "<p><a href='/more'>More of this</a></p>")],
    [(0, "<form><p>Search this site</p><label>Your name</label></form>"), (1, f"<article><p>{_SHORT}</p></article>"), (0, f"<footer><p>{_LONG}</p><p>{_LONG}</p></footer>")],
    [(1, f"<main><article><h1>{_SHORT}</h1><p>{_LONG}</p>"), (0, f'<div class="advert">{_SHORT}</div>'), (1, f"<p>{_LONG}</p><ul><li>{_LONG}</li><li>One</li></ul></article>"), (0, f'<section class="comments"><article><p>{_LONG}</p><p>{_SHORT}</p></article></section></main>')],
    [(0, f'<section class="comments"><article><p>{_LONG} {_LONG}</p></article><article><p>{_SHORT}</p></article></section>'), (0, f'<div class="related"><ul>{_MENU}</ul></div>'), (0, f'<div class="newsletter"><p>{_LONG}</p></div>')],
    [(1, f"<article><p>{_LONG}</p><p><a href='/s'>{_LONG}</a></p><table><tr><td>12</td><td>{_SHORT}</td></tr></table></article>"), (0, f"<aside><article><p>{_LONG}</p></article></aside>"), (0, f"<nav><p>{_LONG}</p></nav>")],
    [(0, f'<div class="menu"><p>Menu</p><ul>{_MENU}</ul></div>'), (1, f"<article><blockquote>{_LONG}</blockquote><p>One</p><p>Two</p><p>Three words here</p></article>"), (0, '<div class="share"><a href="#">Share</a></div>')],
    [(1, f"<div><p>{_LONG} {_LONG}</p></div>"), (0, "<div>All rights reserved</div>")],
    [(1, f"<article><h1>The bridge</h1><p>{_LONG}</p><p>{_SHORT}</p></article>")],
    [(1, f"<main><p>{_SHORT}</p><p>{_LONG}</p><p>One</p></main>")],
    [(1, f"<article><p>{_SHORT}</p></article>")],
    [(1, f'<div class="post"><p>{_SHORT}</p><p><a href="/s">Two words</a></p></div>')],
    [(1, "<article><p>One</p><p>Two</p></article>"), (0, f'<div class="ad">{_SHORT}</div>')],
    [(1, f"<article><p>{_LONG} {_LONG}</p><p><a href='/s'>{_SHORT}</a></p><h3>End</h3></article>")],
    [(0, f'<div class="banner">{_LONG}</div>'), (1, f"<main><h1>One</h1><p>{_LONG} {_LONG}</p></main>")],
    [(1, f"<p>{_LONG}</p><p>{_LONG}</p>")],
    [(1, f"<p>{_LONG} {_LONG}</p>")],
    [(0, f'<div class="sponsored"><p>{_LONG} {_LONG}</p></div>')],
    [(0, "<div>Welcome</div>"), (1, f"<div><h1>The bridge</h1><p>{_LONG} {_LONG}</p><p>{_LONG}</p></div>"), (0, "<div>12 March</div>"), (0, f"<ul>{_MENU}</ul>")],
]


def fit_tree(
    spark: SparkSession, rows: list[tuple[list[float], float]] | None = None, max_depth: int = MAX_DEPTH
) -> Column:
    """Train a decision tree on the labelled table (at most MAX_TRAINING_ROWS rows) and return
    it as an expression of the lambda variable ``b``'s feature array: true for main text."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    rows = labelled_blocks() if rows is None else rows
    if len(rows) > MAX_TRAINING_ROWS:
        raise ValueError(f"at most {MAX_TRAINING_ROWS} labelled blocks")
    train = spark.createDataFrame([(Vectors.dense(f), y) for f, y in rows], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=1, seed=7, maxBins=64).fit(train)
    return tree_sql(model.toDebugString)


def tree_sql(description: str, features: str = "b.f") -> str:
    """SQL of a fitted tree's printed form: If (feature 3 <= 0.5) ... Else ... Predict."""
    lines = [x for x in description.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def walk(k: int) -> tuple[str, int]:
        if m := re.match(r"\s*Predict: ([-\d.]+)", lines[k]):
            return ("true" if float(m[1]) == 1.0 else "false"), k + 1
        m = re.match(r"\s*If \(feature (\d+) <= ([-\d.eE]+)\)", lines[k])
        if not m:
            raise ValueError(f"not a split of a tree over numbers: {lines[k]!r}")
        yes, k = walk(k + 1)
        if not lines[k].lstrip().startswith("Else"):
            raise ValueError(f"no other branch at {lines[k]!r}")
        no, k = walk(k + 1)
        return f"CASE WHEN {features}[{m[1]}] <= {m[2]}D THEN {yes} ELSE {no} END", k

    return walk(0)[0]


def extract_text(
    pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", tree: str | None = None
) -> DataFrame:
    """The columns ``carry``, the page's main ``text`` and ``n_blocks``, the blocks it had."""
    tree = tree or fit_tree(pages.sparkSession)
    blocks = page_blocks(pages, list(carry), html_col)
    text = F.expr(f"array_join(transform(filter(blocks, b -> {tree}), b -> b.text), ' ')")
    return blocks.select(*carry, text.alias("text"), F.size("blocks").alias("n_blocks"))
