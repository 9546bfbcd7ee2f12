"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements; inline elements are transparent, links only count. Chrome is cut
off first: elements that never hold the article (menus, footers, forms, scripts ...) and those whose class, id
or role names such a part, unless they hold the article itself. Every paragraph then passes points for its
length and its commas to its ancestors, less the further up; an element's score is discounted by the share of
its text that lies in links. The best container wins, widened to the article element around it where there is
one, and its siblings are kept where they score or read like text.

A null or empty page has an empty text. Broken markup (unclosed or crossed elements, a page that ends early)
gives the text that is there. Repeated rows are extracted each for itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from conceptstrata.llm.common import short_batches


TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed")}
# Fixed values of HTML: elements by the way they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre section select summary table"
    " tbody td template tfoot th thead tr ul button object svg canvas audio video map math datalist label".split()
)
CHROME = set(
    "aside audio button canvas datalist dialog footer form head header map math menu nav object option select svg template video".split()
)
INLINE = set("audio button canvas datalist label map math object option select svg video".split())  # of these, what a paragraph can hold
CLOSES = {  # an opening element ends an open one of these, up to the element that bounds it
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|footer|sidebars?|aside|ads?|advert\w*|banner|sponsor\w*"
    r"|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|comments?"
    r"|commentlist|disqus|respond|reply|replies|related|recommend\w*|pagination|pager|toolbar|widgets?|skip|search|hidden|print-only|paywall)"
    r"(?:$|[\s_-])",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ARTICLE = {"article", "main"}
LEAST_CHARS = 25  # a shorter paragraph passes no points


class Node:
    __slots__ = ("tag", "parent", "items", "links", "unlikely", "score", "in_link")

    def __init__(self, tag: str, parent: Node | None, unlikely: bool = False):
        self.tag, self.parent, self.unlikely = tag, parent, unlikely
        self.items: list[str | Node] = []  # text and blocks in page order
        self.links, self.score, self.in_link = 0, 0.0, False


def unlikely_part(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and UNLIKELY.search(value):
            return True
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "hidden" and value.lower() != "until-found" or name == "style" and HIDDEN.search(value):
            return True
    return False


class OpenElements:
    """The open elements from the page down, and per tag the depths at which it is open: no element is looked up by walking."""

    def __init__(self, root: Node):
        self.path, self.depths = [root], {root.tag: [0]}

    def deepest(self, tags: set[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def open(self, child: Node) -> None:
        self.depths.setdefault(child.tag, []).append(len(self.path))
        self.path.append(child)

    def close(self, tags: set[str], bounds: set[str]) -> None:
        """Close the nearest open element of `tags` and all in it, unless a bound is nearer."""
        depth = self.deepest(tags)
        if depth > max(0, self.deepest(bounds)):
            for node in self.path[depth:]:
                self.depths[node.tag].pop()
            del self.path[depth:]


def parse(page: str) -> Node:
    root = Node("#page", None)
    opened = OpenElements(root)
    pos, end = 0, len(page)
    while pos < end:
        at = opened.path[-1]
        m = TAG.search(page, pos)
        text = page[pos : m.start() if m else end]
        if text:
            at.items.append(text)
            if at.in_link:
                at.links += len(text)
        if m is None:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in RAW and not closing:
            stop = RAW[tag].search(page, pos)
            pos = stop.end() if stop else end
        elif tag == "a":
            at.in_link = not closing
        elif tag == "br" or tag == "hr":
            at.items.append("\n")
        elif tag in VOID or tag not in BLOCK:
            continue
        elif closing:
            opened.close({tag}, {"#page"})
        else:
            if tag not in INLINE:
                opened.close({"p"}, {"table", "td", "th", "button", "object", "#page"})
            if tag in CLOSES:
                opened.close(*CLOSES[tag])
            at = opened.path[-1]
            child = Node(tag, at, unlikely_part(m[3]))
            at.items.append(child)
            opened.open(child)
    return root


def nodes(root: Node) -> list[Node]:
    """All elements, parents before children."""
    found = [root]
    for node in found:
        found += [x for x in node.items if isinstance(x, Node)]
    return found


def prune(root: Node, by_name: bool) -> None:
    """Cut off chrome. An element that holds the article is no chrome, whatever it is called."""
    holds = set()
    order = nodes(root)
    for node in order:
        if node.tag in ARTICLE:
            up: Node | None = node
            while up is not None and up not in holds:
                holds.add(up)
                up = up.parent
    kept_always = {"html", "body", "#page"} | ARTICLE
    for node in order:
        if node.parent is None or node in holds or node.tag in kept_always:
            continue
        if node.tag in CHROME or by_name and node.unlikely:
            heads = [x for x in nodes(node) if re.fullmatch("h[1-6]", x.tag)] if node.tag == "header" and node.parent in holds and node.parent.tag in ARTICLE else []
            at = node.parent.items.index(node)
            node.parent.items[at : at + 1] = heads  # the title of an article may stand in its own header
            for head in heads:
                head.parent = node.parent


def score(root: Node) -> tuple[Node | None, dict[Node, tuple[int, int]]]:
    """The best container, and per element the characters of its text and of its links."""
    order = nodes(root)
    sizes = {}
    for node in reversed(order):
        own = "".join(x for x in node.items if isinstance(x, str)).strip()
        below = [sizes[x] for x in node.items if isinstance(x, Node)]
        sizes[node] = (len(own) + sum(b[0] for b in below), min(len(own), node.links) + sum(b[1] for b in below))
        if len(own) >= LEAST_CHARS:
            points = (1 + own.count(",") + min(len(own) // 100, 3)) * (1 - min(1.0, node.links / len(own)))
            up, share = node if node.tag not in ("p", "pre", "td", "li", "blockquote") else node.parent, 1.0
            while up is not None and share > 0.1:
                up.score += points * share
                up, share = up.parent, share / 2
    inside: dict[Node, None] = {}  # where the page marks an article, the best container is sought there
    for node in order:
        if sizes[node][0] and (node.tag in ARTICLE or node.parent in inside):
            inside[node] = None
    best = max(inside or order, key=lambda n: n.score * (1 - density(sizes[n])))
    return (best if best.score > 0 or inside else None), sizes


def density(size: tuple[int, int]) -> float:
    return size[1] / size[0] if size[0] else 0.0


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks in page order, white space turned into single blanks."""
    waiting: list[str | Node] = [node]
    run: list[str] = []
    while waiting:
        item = waiting.pop()
        if isinstance(item, str) and item != "\0":
            run.append(item)
            continue
        if run:
            yield " ".join(html.unescape("".join(run)).split())
            run = []
        if isinstance(item, Node):
            waiting += ["\0", *reversed(item.items)]
    if run:
        yield " ".join(html.unescape("".join(run)).split())


def chosen_parts(best: Node, sizes: dict[Node, tuple[int, int]]) -> list[Node]:
    """The container, or the article around it, or the container with those siblings that read like text."""
    up: Node | None = best
    widest = None
    while up is not None:
        if up.tag in ARTICLE:
            widest = up
        up = up.parent
    if widest is not None:
        return [widest]
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least = max(10.0, 0.2 * best.score)
    kept = []
    for item in best.parent.items:
        if not isinstance(item, Node):
            continue
        size = sizes.get(item, (0, 0))
        prose = item.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") and density(size) < 0.25
        if item is best or item.score * (1 - density(size)) >= least or prose:
            kept.append(item)
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    page = page.replace("\0", "�")
    for by_name in (True, False):  # where names cut off all text, they are not heeded
        root = parse(page)
        prune(root, by_name)
        best, sizes = score(root)
        if best is None and by_name and any(n.unlikely for n in nodes(parse(page))):
            continue
        parts = chosen_parts(best, sizes) if best is not None else [root]
        return " ".join(t for part in parts for t in blocks(part) if t)
    return ""


def extract(pages: DataFrame, html_column: str = "html", to: str = "text") -> DataFrame:
    """The rows without their markup, with the main text and its length in code points."""
    short_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_column, to, "n_chars")]
    schema = T.StructType([*pages.select(keep).schema.fields, T.StructField(to, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(batch.num_columns - 1)]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    return pages.select(*keep, html_column).mapInArrow(run, schema)
