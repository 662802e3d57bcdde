"""The main text of web pages, by scoring their trees.

A page is read once into a tree of open elements; text between block borders is a paragraph. Paragraphs give points for
length and commas to their container, half of them to the container above, a third of that half further up; a container's
points count less by its share of link text. The best container is kept, with those siblings that score well beside it; if
it lies in an article element, that whole article and other articles that score well.

Elements that are no text by their tag, role or as hidden (menus, headers, footers, sidebars, forms, scripts) give none.
Class names and ids only speak of boxes: one made of nothing but words for adverts, comments, notices, menus and the like
takes its box away, unless the box holds most of the page (comments stay away). Words that also name text (social, related,
share ...) take it away only if it scores low beside the best container. Lists made of links go where they stand before
or after all other text of the container, but stay inside an article element. Ids of paragraphs and headings are anchors
and say nothing.

Cases: a null or empty page has the empty text, as has a page without any text. Unclosed and crossing tags are closed as
browsers do; a tag that the page's end cuts off is dropped. Pages may be of any length and depth: reading and scoring take
time in proportion to the length. Repeated rows each get their row; other columns are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomery.llm import spill, textkit

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?][^>]*+>|/?[a-zA-Z][^>]*+\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+))?""", re.I)

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("head nav footer aside form button select textarea option script style noscript iframe object embed template svg canvas title dialog menu audio video xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag that ends an open element of the same group, up to the nearest element named after it.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Words of class names. A name that joins them with BOX_WORDS only marks its box.
COMMENT_WORDS = frozenset("comment comments commentlist commenter disqus respond replies reply".split())
NOT_TEXT_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr popup modal overlay "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead newsletter pagination pager toolbar signup login".split()
)
MAYBE_WORDS = frozenset("notice notices alert social share sharing related recommended recommendations promoted subscribe subscription widget widgets search skip topbar side hidden".split())
BOX_WORDS = frozenset("area bar block box button buttons col column container content count footer form group header inner item items left line link links list main message outer panel post posts articles stories right row section site slot text title top bottom global unit wrap wrapper page".split())
TEXT_WORDS = frozenset("article entry post content body main story text".split())


class _Node:
    __slots__ = ("tag", "up", "block", "off", "inside", "header", "mark", "inline", "near", "own", "below", "size", "linked", "links", "kept", "menu")

    def __init__(self, tag: str, up: _Node | None, off: bool = False, mark: int = 0):
        self.tag, self.up, self.off, self.mark = tag, up, off, mark
        inline = tag in INLINE and up is not None
        self.block = up.block if inline else self
        self.inline = None if inline else {}  # open inline elements by tag
        self.inside = tag in ("article", "main") or (up is not None and up.inside)
        self.header = tag == "header" or (up is not None and up.header)
        self.near = up.near if up else {}  # the nearest element of each group in CLOSES
        if tag in _GROUP:
            self.near = self.near | {_GROUP[tag]: self}
        self.own = self.below = 0.0
        self.size = self.linked = self.links = 0
        self.kept = self.menu = False


#: The group of tags in which an element's end may be left out, for each tag of it.
_GROUP = {"li": "list", "ul": "list", "ol": "list", "dt": "dl", "dd": "dl", "dl": "dl", "tr": "table", "td": "table", "th": "table", "table": "table"}


def _off(tag: str, found: dict[str, str], up: _Node) -> bool:
    if tag in NO_TEXT or (tag == "header" and not up.inside):
        return True
    if not found:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    return found.get("role", "").lower() in NOT_TEXT_ROLES


def _mark(tag: str, found: dict[str, str], up: _Node) -> int:
    """0, or what class and id say of a box: 1 for maybe no text, 2 for no text, 3 for comments."""
    if not found or tag in ("html", "body", "main"):
        return 0
    names = found.get("class", "").split()
    if tag not in INLINE and tag != "p" and tag not in HEADINGS and tag != "li":
        names += found.get("id", "").split()
    mark = 0
    for name in names:
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}
        if words == {"header"} or (words == {"site", "header"}):
            mark = max(mark, 0 if up.inside else 2)
        for kind, known in ((3, COMMENT_WORDS), (2, NOT_TEXT_WORDS), (1, MAYBE_WORDS)):
            if words & known and words <= known | NOT_TEXT_WORDS | MAYBE_WORDS | BOX_WORDS:
                mark = max(mark, kind)
    return 0 if mark == 1 and TEXT_WORDS & set(names) else mark


def _read(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int, int]]]:
    """All elements that may hold text, parents first, and the paragraphs in page order: innermost block element, text,
    length of its link text, number of links."""
    here = root = _Node("", None)
    nodes = [root]
    out: list[tuple[_Node, str, int, int]] = []
    held: list[str] = []
    linked = links = 0
    in_link = False
    blocks: dict[str, int] = {}  # open block elements by tag

    def flush() -> None:
        nonlocal linked, links, in_link
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((here.block, text, min(linked, len(text)), links))
            held.clear()
        linked = links = 0
        in_link = False

    def take(text: str) -> None:
        nonlocal linked
        if text and not here.off:
            held.append(text)
            if in_link:
                linked += len(text.strip())

    def close(last: _Node) -> None:
        """Ends all open elements up to ``last``."""
        nonlocal here
        node = here
        while True:
            if node.inline is None:
                node.block.inline[node.tag] -= 1
            else:
                blocks[node.tag] -= 1
            if node is last:
                break
            node = node.up
        here = last.up

    at, find = 0, _TAG.search
    while m := find(page, at):
        take(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag; of an inline element, only within its block
            if tag in INLINE:
                if here.block.inline.get(tag):
                    node = here
                    while node.tag != tag:
                        node = node.up
                    close(node)
            elif blocks.get(tag):
                flush()
                node = here
                while node.tag != tag or node.inline is None:
                    node = node.up
                close(node)
            if tag == "a":
                in_link = False
            continue
        if tag not in INLINE:
            flush()
            if (tag not in VOID or tag == "hr") and here.block.tag == "p":  # a block ends an open p
                close(here.block)
            if tag in CLOSES:
                ends, stop = CLOSES[tag]
                node, last = here.near.get(_GROUP[tag]), None
                while node and node.tag not in stop:
                    last = node if node.tag in ends else last
                    node = node.up.near.get(_GROUP[tag])
                if last:
                    close(last)
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link, links = True, links + 1
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            at = page.find(">", end.end() - 1) + 1 if end else len(page)
            at = at or len(page)
            continue
        attributes = m[3] or m[6]
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        off = here.off or _off(tag, found, here)
        here = _Node(tag, here, off, 0 if off else _mark(tag, found, here))
        nodes.append(here)
        if here.inline is None:
            here.block.inline[tag] = here.block.inline.get(tag, 0) + 1
        else:
            blocks[tag] = blocks.get(tag, 0) + 1
    take(page[at:])
    flush()
    return [n for n in nodes if not n.off], [x for x in out if not x[0].off]


def _score(nodes: list[_Node], blocks: list[tuple[_Node, str, int, int]]) -> None:
    """Points, text, link text and links of every element, from the leaves up."""
    for n in nodes:
        n.own = n.below = 0.0
        n.size = n.linked = n.links = 0
    for node, text, linked, links in blocks:
        points = (1 if len(text) >= 25 else 0.25) + text.count(",") + min(len(text) / 100, 3)
        box = node.up if (node.tag == "p" or node.tag in HEADINGS) and node.up else node
        box.own += points * (1 - linked / len(text))
        node.size, node.linked, node.links = node.size + len(text), node.linked + linked, node.links + links
    for n in reversed(nodes):
        if up := n.up:
            up.below += n.own / 2 + n.below / 3
            up.size, up.linked, up.links = up.size + n.size, up.linked + n.linked, up.links + n.links


def _worth(n: _Node) -> float:
    return (n.own + n.below) * (1 - n.linked / max(1, n.size))


def _without_boxes(nodes: list[_Node], blocks: list[tuple[_Node, str, int, int]]) -> list[tuple[_Node, str, int, int]]:
    """The paragraphs outside boxes that their names and scores say are no text."""
    if not any(n.mark for n in nodes):
        return blocks
    _score(nodes, blocks)
    best = max((_worth(n) for n in nodes if not n.mark), default=0.0)
    page = nodes[0].size if nodes else 0
    for n in nodes:
        up = bool(n.up and n.up.menu)
        mark = n.mark
        if mark == 2 and 3 * n.size > 2 * page:
            mark = 0
        if mark == 1 and n.tag != "p" and _worth(n) >= 0.25 * best:
            mark = 0
        n.menu = up or mark > 0
    left = [x for x in blocks if not x[0].menu]
    return left or blocks


def _choose(nodes: list[_Node], blocks: list[tuple[_Node, str, int, int]]) -> list[str]:
    blocks = _without_boxes(nodes, blocks)
    if not blocks:
        return []
    _score(nodes, blocks)
    best = max((n for n in nodes if n.size), key=_worth)
    top = best
    box: _Node | None = best
    while box:
        if box.tag == "article":
            top = box
        box = box.up
    enough = max(10, 0.2 * _worth(best))
    for n in nodes:
        up = bool(n.up and n.up.kept)
        if top.tag == "article":
            n.kept = up or n is top or (n.tag == "article" and _worth(n) >= enough)
        else:
            beside = n.up is top.up and n.size and (_worth(n) >= enough or n.tag in HEADINGS or (n.tag == "p" and n.size > 80 and n.linked < 0.25 * n.size))
            n.kept = up or n is top or bool(beside)
        listed = up and top.tag != "article" and n.tag in ("ul", "ol", "div") and n.links >= 3 and n.linked >= 0.75 * n.size
        n.menu = bool(n.up and n.up.menu) or listed
    found = [(node.menu, text) for node, text, _, _ in blocks if node.kept and (not node.header or node.tag in HEADINGS)]
    texts = [i for i, (menu, _) in enumerate(found) if not menu]
    return [text for _, text in found[texts[0] : texts[-1] + 1]] if texts else []


def main_text(page: str | None) -> str:
    """Paragraphs of the main text, joined by one newline."""
    return "\n".join(_choose(*_read(page))) if page else ""


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: key, url, ``text`` and ``n_chars``. No shuffle."""
    spark = df.sparkSession
    spill.small_batches(spark)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.batches(tables):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["k", "u", "text", "n_chars"])

    rows = textkit.one_text_column(df, key, url, text=page)
    kinds = [rows.schema[c].dataType.simpleString() for c in (key, url)]
    return rows.mapInArrow(run, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long").withColumnsRenamed({"k": key, "u": url})


def op3_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
