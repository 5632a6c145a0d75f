"""Main text of web pages by composite text density.

The page becomes a tree with a node for every element; an end tag also closes what is still open inside its element, and
start tags close paragraphs and list items as browsers do. Every node gets its link-adjusted density: characters outside
links for each tag, links counting as tags once more. A node's density sum adds up its children.

Text without links is dense in notices and reader comments too, so an element's kind (navigation, forms) and the words of
its class, id or role (adverts, notices, comments) are evidence against it. Such an element adds nothing to the elements
around it, and its own sums are divided: by ``FIRM`` where the evidence is firm, by ``LOOSE`` where such words also name
articles (``post-form``). Firm evidence leaves an element out at once where no ``h1``, ``main`` or ``article`` stands
in it, loose evidence where fewer than two headings or paragraphs do; with an ``h1`` inside it divides nothing.

The block with the largest sum is the body of the article, evidence or not; all evidence it does not lie in leaves its
elements out, and so does all text outside the innermost element with evidence that it lies in. The smallest density on
the path from that element (or the page's body) to it is the threshold, and every part that reaches it gives its own
largest-sum subtree. A subtree in an ``article`` is widened to it, otherwise one in ``main`` to that, without what is
links alone; a heading ``h1`` beside the path belongs to the article.

Reader comments without any telling name count as text. Null and empty pages, and pages without text, give an empty string. Very long pages are read whole. Of equal sums the
first node in page order counts. Repeated rows each get a row; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import own, read, slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[a-zA-Z/][^>]*>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
#: Elements whose content is text up to their end tag, and no article.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that never hold article text.
OUT = RAW | frozenset("head template noscript svg math object button select canvas audio video map datalist".split())
#: Elements that seldom hold article text.
ASIDE = frozenset("nav header footer aside form menu dialog".split())
#: Words of a class, id or role that speak against an element, and those that also stand in names of articles.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs header footer masthead "
    "sidebar aside comment comments discussion respond disqus cookie cookies consent popup modal overlay newsletter subscribe login "
    "toolbar pagination pager complementary contentinfo".split()
)
LOOSE_MARKS = frozenset("promo banner related recommended reply replies notice notices alert signup share sharing social widget search form".split())
#: First words of names that tell what an element is combined with, and last words of names of articles.
STATES, ARTICLES = frozenset("no has with without is not hide show".split()), frozenset("article story main".split())
#: Elements that only a page's own text has, and parts that one paragraph of a notice lacks.
HEADINGS, PARTS = frozenset("article main h1".split()), frozenset("article main h1 h2 h3 h4 h5 h6 p".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag closes if it comes inside them, or inside inline elements in them.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: What the density sums of elements with firm and loose evidence are divided by.
FIRM, LOOSE = 6.0, 3.0


class Node:
    """An element: its children and its own runs of text, in order."""

    __slots__ = ("against", "chars", "density", "items", "kind", "links", "out", "parent", "reply", "tags", "total", "weight")

    def __init__(self, kind: str, parent: Node | None, against: float = 0.0, out: bool = False):
        self.kind, self.parent, self.items, self.against, self.out = kind, parent, [], against, out
        self.reply = False
        self.chars = self.links = self.tags = 0
        self.density, self.total, self.weight = 0.0, 0.0, 1.0


def _against(kind: str, attributes: str) -> float:
    """What an element's sums are divided by; 0 without evidence against it."""
    found = LOOSE if kind == "form" else FIRM if kind in ASIDE else 0.0
    if "=" not in attributes or kind in ("body", "html", "main"):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for name in m[2].strip("\"'").split():
                words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
                if words and words[0] not in STATES and words[-1] not in ARTICLES:
                    found = max(found, 0.0 if MARKS.isdisjoint(words) else FIRM, 0.0 if LOOSE_MARKS.isdisjoint(words) else LOOSE)
    return found


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree and its nodes in page order. Text runs are (text, inside a link); None is a line break."""
    at = root = Node("body", None)
    nodes, raw = [root], ""
    for m in _TOKEN.finditer(page):
        kind = m[2].lower() if m[2] else ""
        if raw:
            raw = "" if kind == raw and m[1] else raw
        elif not kind:
            if m[0][0] != "<" or m[0] == "<":
                at.items.append(m[0])
        elif m[1]:
            up = at
            while up is not None and up.kind != kind:
                up = up.parent if kind not in INLINE or up.kind in INLINE else None  # an inline end tag closes no block
            if up is not None and up.parent is not None:
                at = up.parent
        elif kind in VOID:
            if kind in ("br", "hr"):
                at.items.append(None)
            at.tags += 1
        elif kind in RAW:
            raw = "" if m[3].endswith("/") else kind
        elif kind not in ("html", "body"):
            if kind not in INLINE:
                ends, up = CLOSES.get(kind, {"p"}), at
                while up.kind in INLINE or up.kind in ends:
                    if up.kind in ends:
                        at = up.parent
                    up = up.parent
            against = _against(kind, m[3])
            child = Node(kind, at, 0.0 if kind == "article" else against, kind in OUT)
            child.reply = kind == "article" and against == FIRM  # as around each comment
            at.items.append(child)
            nodes.append(child)
            at = at if m[3].endswith("/") and kind not in INLINE else child
    return root, nodes


def judge(nodes: list[Node]) -> None:
    """Leaves out what cannot hold an article, and weighs the evidence against the rest."""
    above: dict[int, tuple] = {}  # the nearest elements with evidence and with firm evidence
    parts: dict[int, int] = {}
    heads: set[int] = set()
    titled: set[int] = set()
    for node in nodes:
        near, firm = above[id(node.parent)] if node.parent else (None, None)
        if near is not None and node.kind in PARTS:
            parts[id(near)] = parts.get(id(near), 0) + 1
        if firm is not None and node.kind in HEADINGS and not node.reply:
            heads.add(id(firm))
        if near is not None and node.kind in ("h1", "main"):
            titled.add(id(near))
        above[id(node)] = (node if node.against else near, node if node.against == FIRM else firm)
    for node in nodes:
        lost = id(node) not in heads if node.against == FIRM else node.against == LOOSE and parts.get(id(node), 0) < 2
        node.out = node.out or lost or bool(node.parent and node.parent.out)
        if node.parent:
            node.weight = node.parent.weight / (1.0 if node.against == LOOSE and id(node) in titled else node.against or 1.0)


def weigh(nodes: list[Node]) -> None:
    """Counts and densities from the leaves up. What is left out, or has evidence against it, adds nothing to its parent."""
    for node in reversed(nodes):
        if node.out:
            continue
        link = node.kind == "a"
        for item in node.items:
            if isinstance(item, str):
                node.chars += len(item.strip())
            elif item is not None and not item.out and not item.against:
                node.chars += item.chars
                node.links += item.links
                node.tags += item.tags + 1
                node.total += item.density
        node.links = node.chars if link else node.links
        outside = node.chars - node.links
        node.density = outside / max(1, node.tags) * (outside / node.chars) if node.chars else 0.0


def _children(node: Node) -> list[Node]:
    return [x for x in node.items if isinstance(x, Node) and not x.out and x.kind not in INLINE]


def _largest(top: Node) -> Node:
    best, todo = top, [top]
    while todo:
        node = todo.pop()
        if (node.total or node.density if node is top else node.total) > (best.total or best.density if best is top else best.total):
            best = node
        todo += _children(node)
    return _article(_block(best, top), top)


def _block(node: Node, top: Node) -> Node:
    """A paragraph, however much its inline elements add up to, is a part of what it stands in."""
    while node is not top and node.parent is not None and not _children(node):
        node = node.parent
    return node


def _path(node: Node, top: Node) -> list[Node]:
    path = [node]
    while path[-1] is not top:
        path.append(path[-1].parent)
    return path


def _article(node: Node, top: Node) -> Node:
    """The nearest article around ``node`` below ``top``, otherwise the nearest main element, otherwise ``node``."""
    path = _path(node, top)
    return next((n for kind in ("article", "main") for n in path if n.kind == kind and not n.reply), node)


def content(root: Node, nodes: list[Node]) -> set[int]:
    """Identities of the nodes whose subtrees are the article."""
    judge(nodes)
    weigh(nodes)
    best = max((n for n in nodes if not n.out and n.kind not in INLINE), key=lambda n: n.total * n.weight)  # the first of equals
    top = best
    while top.parent is not None and not top.against:
        top = top.parent
    best = _block(best, top)
    path = _path(best, top)
    inside = {id(n) for n in _path(top, root)} | {id(n) for n in path}
    for node in nodes:  # evidence stands wherever density has not outweighed it
        node.out = node.out or bool(node.against and id(node) not in inside) or bool(node.parent and node.parent.out)
    if not best.total:
        return {id(top)}
    whole = _article(best, top)
    if whole.kind == "main" and whole is not best:
        kept, within = {id(n) for n in path}, set()
        for node in nodes:
            if node is not best and (node is whole or id(node.parent) in within):
                within.add(id(node))
                node.out = node.out or bool(node.chars and not node.density and node.kind not in INLINE and id(node) not in kept)
    threshold, above = min(n.density for n in path), {id(n) for n in _path(whole, top)[1:]}
    chosen, todo = {id(whole)}, [top]
    chosen |= {id(x) for n in _path(whole, top)[1:] for x in n.items if isinstance(x, Node) and x.kind == "h1"}
    while todo:
        node = todo.pop()
        if node.chars and node.density >= threshold and node is not top and id(node) not in above:
            chosen.add(id(_largest(node)))
        if id(node) not in chosen:
            todo += _children(node)
    return chosen


def blocks(root: Node, chosen: set[int]) -> list[str]:
    """Texts of the chosen subtrees in page order; a line break ends a block as a block element does."""
    out, run = [], []

    def flush():
        if run and (text := " ".join(entities.unescape("".join(run)).split())):
            out.append(text)
        run.clear()

    todo: list = [(root, id(root) in chosen, iter(root.items))]
    while todo:
        node, inside, items = todo[-1]
        for item in items:
            if isinstance(item, Node):
                if item.kind not in INLINE:
                    flush()
                if not item.out:
                    todo.append((item, inside or id(item) in chosen, iter(item.items)))
                    break
            elif item is None:
                flush()
            elif inside:
                run.append(item)
        else:
            if node.kind not in INLINE:
                flush()
            todo.pop()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, nodes = parse(page)
    return "\n".join(blocks(root, content(root, nodes)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""

    def run(batches):
        for batch in slices(batches, 2):
            texts = [main_text(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
