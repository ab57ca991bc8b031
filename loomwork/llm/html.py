"""Main text of web pages by tree scoring.

A page is read into a tree of block elements (inline markup does not matter to
the text). Parts whose element or class names them as menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments are left
out, hidden elements too, inline ones alike. Every block with text of its own
passes points for its length and commas to its parent and, less, to the
ancestors above; a block's points are discounted by its link density. The best
block is widened to the article or main element around it, with the sibling
articles that gather a fifth of its points, or else is joined by siblings that
score a fifth of it or are paragraphs of prose. All text in them is kept in page
order, but for lists and boxes that consist of links, outside of article and
main. The points (a block of 25 characters or more gives 1, its commas and up to
3 for its length; ancestors get all, a half, then a third of that by level) are
those of the publicly known readability scoring.

Inside an article or main element, or a block named as content, a class name
counts only if all its parts do (`social-share`, not `social-history`).

A form, fieldset or block left out by its name is taken back where it holds over
five times the points of all that is kept (a form around the page, a post marked
`tag-...`) and no article or main element has text; reader comments only where nothing else has points. Headings and
sections beside the best block stay.

Defined cases: null or empty html gives an empty text; without any points the
article, main or body element with the most text is taken, and without body
the page; of equal points the first block wins; unclosed elements end with their
parent; an unclosed script, style, title or textarea takes the rest, of other
unclosed embedded elements only the tag goes; a self-closing one is empty; stray
end tags are ignored; html that is plain text is one block; repeated rows each
give a row; further columns of any name do no harm; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.base import arrow_schema, map_batches

# A tag's parts are bounded or pass no "<", and an end that is not there is looked for once, so a page is read in linear time.
_TAG = r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+|(?:[^<>"']++|"[^"]{0,4096}+"|'[^']{0,4096}+')*+|[^<>]*+)>"""
NEXT = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<![^<>]*+>|<\?[^<>]*+>|" + _TAG)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""")
HINT = re.compile(r"(?i)\b(?:class|id|hidden|style|role)\b")

# Elements whose content is no text of the page; what stands for them; those that take the rest if unclosed.
RAW = {"script": "", "style": "", "noscript": "", "template": "", "title": "", "textarea": " ", "iframe": " ", "svg": " ", "math": " ", "object": " ", "select": " ", "canvas": " "}
RAW_END = {tag: re.compile(rf"(?i)</{tag}\s*+[^<>]*+>") for tag in RAW}
TAKES_REST = frozenset(("script", "style", "title", "textarea"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav header footer aside form menu dialog fieldset search button input label legend".split())
INLINE_DROPPED = frozenset("button label".split())
CLOSES_P = BLOCKS - {"li", "dd", "dt", "td", "th", "tr"} | {"hr"}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section main body aside nav td th blockquote".split())
NAMED_OUT = frozenset(
    "ad ads adslot advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus"
    " footer gdpr masthead menu menus modal nav navbar navigation newsletter pager pagination popup promo promoted promotion recommended replies respond rss share"
    " sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
NAMED_OUT_UNLESS_CONTENT = frozenset("alert disclaimer header login notice notices related responses search side signup tag tags".split())
CONTENT = frozenset("article body content entry main post story text".split())
WITHOUT = frozenset("has have hide is no with without".split())  # "has-sidebar" is not a sidebar
# Inline elements with such names are left out.
NAMED_OUT_INLINE = frozenset("ad ads adslot advert adverts advertisement advertising popup promo promoted share sharing skip sponsor sponsored".split())
# Names of reader comments.
TALKS = frozenset("comment comments commentlist disqus replies respond responses".split())
# Parts of names that say nothing of the content.
NEUTRAL = frozenset(
    "a above all area articles bar below block body bottom box btn button buttons card center col column container content cta desktop end entry feed first float form frame"
    " google group holder icon icons id in inline inner item items js last layout left level link links list main message mid middle mobile module new no of on"
    " outer overlay page panel placeholder policy post posts primary reader region right row script secondary section series sign site slot small sticky strip thread"
    " stories text the title to top ui unit up user view wide wrap wrapper x zone article story".split()
)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
LONG_ENOUGH = 25


class Block:
    __slots__ = ("tag", "parent", "children", "mark", "dropped", "article", "inside", "content", "own", "links", "chars", "link_chars", "points", "total")

    def __init__(self, tag: str, parent: Block | None, mark: int, content: bool = False):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.dropped = mark > 0 or parent is not None and parent.dropped
        self.children: list = []  # blocks and strings (inline text), in page order
        self.article = tag == "article" or parent is not None and parent.article
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.content = self.inside or content or parent is not None and parent.content
        self.own = self.links = self.chars = self.link_chars = 0
        self.points = self.total = 0.0  # points passed to the block; points of all text in it
        if parent is not None:
            parent.children.append(self)


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)}


def _hidden(found: dict[str, str]) -> bool:
    style = found.get("style", "").replace(" ", "").lower()
    return "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _parts(found: dict[str, str]) -> Iterator[list[str]]:
    """The parts of each class name and of the id; `has-sidebar` is not a sidebar."""
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if parts and parts[0] not in WITHOUT:
            yield parts


def _out(parts: list[str], strict: bool, article: bool = False) -> bool:
    """Whether a name marks what is no part of the main text.

    `strict`: only if its other parts say nothing (small numbers among them, years not). In an article a header is its own.
    """
    own = set(parts)
    doubtful = own & NAMED_OUT_UNLESS_CONTENT - ({"header"} if article else set())
    if not (own & NAMED_OUT or doubtful and not own & CONTENT):
        return False
    return not strict or all(p in NAMED_OUT or p in NAMED_OUT_UNLESS_CONTENT or p in NEUTRAL or p.isdigit() and len(p) < 4 for p in own)


# Why a block is left out: it may be taken back, holds comments, or is out for good.
MAYBE, TALK, NEVER = 1, 2, 3


def _unwanted(tag: str, found: dict[str, str], parent: Block) -> int:
    """0, or why a block element is no part of the main text."""
    if tag in DROPPED:
        return 0 if tag == "header" and parent.inside else MAYBE if tag in ("form", "fieldset") and not _hidden(found) else NEVER
    if not found or tag in ("html", "body", "article", "main"):
        return 0
    if _hidden(found) or found.get("role", "").lower() in ROLES:
        return MAYBE if not _hidden(found) and found["role"].lower() == "form" else NEVER
    named = [set(parts) for parts in _parts(found) if _out(parts, parent.content, parent.article)]
    return 0 if not named else TALK if any(parts & TALKS for parts in named) else MAYBE


def _unwanted_inline(found: dict[str, str]) -> bool:
    """Whether an inline element is hidden, an advert or a button to share."""
    return _hidden(found) or any(set(parts) & NAMED_OUT_INLINE and _out(parts, True) for parts in _parts(found))


def parse(html: str) -> Block:
    """The tree of block elements; strings among the children are (decoded text, inside a link)."""
    root = Block("#root", None, 0)
    cur, link, at = root, 0, 0
    open_: dict[str, int] = {}  # how many elements of a kind are open
    veil: list | None = None  # an inline element that is left out: its tag, how many of them are open, the block around it
    endless: set[str] = set()  # embedded elements that have no end from here on

    def close(node: Block) -> None:
        """Close the node and all that is open in it."""
        nonlocal cur, veil
        while True:
            if veil and veil[2] is cur:
                veil = None
            open_[cur.tag] -= 1
            last, cur = cur, cur.parent
            if last is node:
                return

    def put(text: str) -> None:
        if text and not veil:
            cur.children.append((unescape(text) if "&" in text else text, link > 0))

    while m := NEXT.search(html, at):
        put(html[at : m.start()])
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        empty = attributes.endswith("/")
        if tag in RAW:
            if not closing and not empty:
                put(RAW[tag])
                end = None if tag in endless else RAW_END[tag].search(html, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
                    if tag in TAKES_REST:
                        at = len(html)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                put(" ")
            if tag == "hr" and cur.tag == "p":
                close(cur)
            continue
        if tag not in BLOCKS:
            if tag == "a":
                link = 0 if closing else 1
            if veil:
                if tag == veil[0] and not empty:
                    veil[1] += -1 if closing else 1
                    if not veil[1]:
                        veil = None
            elif not closing and not empty and (tag in INLINE_DROPPED or HINT.search(attributes) and _unwanted_inline(_attributes(attributes))):
                veil = [tag, 1, cur]
            continue
        link = 0
        if closing:
            if open_.get(tag):
                node = cur
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        if tag in CLOSES_P and cur.tag == "p":
            close(cur)
        if tag in SAME and any(open_.get(t) for t in SAME[tag]):
            node = cur
            while node.parent is not None and node.tag not in SAME[tag] and node.tag not in SCOPES:
                node = node.parent
            if node.tag in SAME[tag]:
                close(node)
        found = _attributes(attributes) if HINT.search(attributes) else {}
        content = any(set(p) & CONTENT for p in _parts(found))
        cur = Block(tag, cur, NEVER if veil is not None else _unwanted(tag, found, cur), content)
        open_[tag] = open_.get(tag, 0) + 1
        if empty and tag not in ("p", "li", "body", "html"):
            close(cur)
    put(html[at:])
    return root


def _walk(root: Block) -> Iterator[Block]:
    """Blocks in page order, children after parents (no recursion: pages nest deeply)."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Block))


def take_back(root: Block) -> None:
    """Marks go from blocks that hold most of the page."""
    nodes = list(_walk(root))
    if not any(n.mark in (MAYBE, TALK) for n in nodes):
        return
    own = {}
    for n in nodes:
        texts = [c for c in n.children if not isinstance(c, Block)]
        plain = len(" ".join("".join(t for t, linked in texts if not linked).split()))
        own[n] = 1 + min(plain / 100, 3) + sum(t.count(",") for t, _ in texts) if plain >= LONG_ENOUGH else 0.0
    while True:
        kept = sum(own[n] for n in nodes if not n.dropped)
        words = {n.inside for n in nodes if not n.dropped for c in n.children if not isinstance(c, Block) and c[0].strip()}
        if True in words:
            return  # an article has text
        if words and not kept:
            kept = 1.0  # a short text counts as a paragraph
        held = dict.fromkeys(nodes, 0.0)  # by a block and those in it that may be taken back with it
        for n in reversed(nodes):
            held[n] += own[n]
            if n.parent is not None and n.mark in (0, MAYBE):
                held[n.parent] += held[n]
        outer = [n for n in nodes if n.mark in (MAYBE, TALK) and not n.parent.dropped and held[n] > (5 * kept if n.mark == MAYBE else 0) and (n.mark == MAYBE or not kept)]
        if not outer:
            return
        best = max(outer, key=lambda n: (n.mark == MAYBE, held[n]))
        best.mark = 0
        for n in nodes:
            n.dropped = n.mark > 0 or n.parent is not None and n.parent.dropped


def score(root: Block) -> list[Block]:
    """Fill in sizes and points; blocks in page order that are not left out."""
    take_back(root)
    nodes = [n for n in _walk(root) if not n.dropped]
    for n in nodes:
        text = "".join(t for c in n.children if not isinstance(c, Block) for t in (c[0],))
        n.own = len(" ".join(text.split()))
        linked = [len(" ".join(c[0].split())) for c in n.children if not isinstance(c, Block) and c[1]]
        n.links = sum(x > 0 for x in linked)
        n.chars, n.link_chars = n.own, sum(linked)
        if n.own >= LONG_ENOUGH and n.parent is not None:
            points = 1 + text.count(",") + min(n.own / 100, 3)
            n.total += points
            if n.tag not in ("p", "pre", "td", "li", "blockquote"):
                n.points += points  # loose text of a container
            level, up = 0, n.parent
            while up is not None and level < 6:
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level, up = level + 1, up.parent
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
            n.parent.links += n.links
            n.parent.total += n.total
    return nodes


def density(n: Block) -> float:
    return n.link_chars / n.chars if n.chars else 0.0


def worth(n: Block) -> float:
    return n.total * (1 - density(n))


def choose(nodes: list[Block]) -> list[Block]:
    """The blocks whose text is the main text, in page order."""
    if not nodes:
        return []
    inner = [n for n in nodes if n.tag not in ("#root", "html")] or nodes
    best = max(inner, key=lambda n: n.points * (1 - density(n)))
    if best.points <= 0:
        for tags in (("article",), ("main",), ("body",), ("#root",)):
            found = [n for n in nodes if n.tag in tags and n.chars]
            if found:
                return [max(found, key=lambda n: n.chars - n.link_chars)]
        return []
    if best.tag == "body":
        whole = [n for n in nodes if n.tag in ("article", "main") and n.points > 0]
        if whole and sum(n.chars for n in whole) * 2 > best.chars:
            best = max(whole, key=lambda n: n.points)
    up, node = None, best  # the outermost article, or else the innermost main
    while node is not None:
        if node.tag == "article" or node.tag == "main" and up is None:
            up = node
        node = node.parent
    if up is not None and up.tag == "article":
        beside = [c for c in up.parent.children if isinstance(c, Block) and c.tag == "article" and not c.dropped]
        return [c for c in beside if c is up or worth(c) >= 0.2 * worth(up) and c.total]
    if up is not None:
        return [up]
    if best.parent is None:
        return [best]
    least = 0.2 * best.points * (1 - density(best))
    beside = [c for c in best.parent.children if isinstance(c, Block) and not c.dropped]
    out = []
    for c in beside:
        prose = c.tag in ("p", "pre", "blockquote") and (c.chars > 80 and density(c) < 0.25 or 0 < c.chars <= 80 and not c.link_chars)
        heading = c.tag in HEADINGS and c.chars and not c.link_chars
        section = c.tag == "section" and c.tag == best.tag and c.chars and density(c) < 0.25
        if c is best or c.points * (1 - density(c)) >= least or prose or heading or section:
            out.append(c)
    while out[-1].tag in HEADINGS and out[-1] is not best:  # of what is left out
        out.pop()
    return out


def text_of(blocks: list[Block]) -> str:
    """Text of the blocks in page order, white space inside a block as one space, blocks joined by one."""
    parts: list[str] = []
    stack: list = list(reversed(blocks))
    run: list[str] = []
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            run.append(node[0])
            continue
        parts.append("".join(run))
        run = []
        if node is None:
            continue
        boring = node.tag in ("ul", "ol", "div", "table", "section") and not node.inside and node not in blocks and node.links > 2 and density(node) >= 0.8 and node.chars < 60 * node.links
        if node.dropped or boring:
            continue
        stack.append(None)  # the block's end
        stack.extend(reversed(node.children))
    parts.append("".join(run))
    return " ".join(" ".join(parts).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return text_of(choose(score(parse(html))))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    ddl = "page_id long, url string, text string, n_chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(slim, run, ddl)
