"""Main text of web pages by composite text density.

For every DOM node: characters and tags of its subtree, and those inside links.  The composite
density is characters per tag, adjusted by a logarithm whose base grows with the share of
linked characters, so that link lists fall below prose.  A node's density sum is the sum over
its blocks; inline elements are part of the block that holds them, whose own text counts as one more.
The node with the largest sum is found; the threshold is the smallest density on
its path from the body; of the nodes that reach the threshold the one with the largest sum is
the main text.  It widens to its parent, the body excepted, while blocks beside it that reach the threshold hold
a ``WIDER`` part of its text or more, or where a sister of it (same element with the same class, or a section or article like it) holds plain text, so that the
short sections, titles and tails of an article come with its long ones; and, as a tie-break, to the article or main
around it of whose text it holds more than half.

Navigation, page heads and feet, forms, scripts, styles, hidden nodes and
containers named as adverts, notices, sidebars or comments are dropped before.  A name that follows has-,
no- or with- says nothing, and a named container or a form stays if it holds the page's main element, all of its
articles, or most of its unlinked text with no article beside it.  Where names would leave next to nothing of a
page's text, they don't count.

Null and empty pages, and pages without text, give an empty text.  Pages may end anywhere: open
elements end with the page and an unfinished tag is dropped.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset("script style noscript template head title nav footer aside button select option textarea iframe object svg canvas audio video dialog menu input".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What an opening tag closes, up to the nearest of its containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"body", "html", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
SCOPE = frozenset(("table", "td", "th", "html", "button", "object", "caption"))
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|sidebar|side-bar|menu|navbar|nav|navigation|breadcrumbs?|footer|masthead|site-header|page-header|"
    r"share|sharing|social|related|recommended|comments?|commentlist|comment-list|disqus|respond|replies|newsletter|subscribe|signup|popup|modal|overlay|pagination|pager|widgets|widget-area|toolbar|skip-link|paywall)(?:$|[\s_-])",
    re.I,
)
QUALIFIED = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-]\S*", re.I)
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
WIDER = 0.2


class Node:
    __slots__ = ("attrs", "chars", "children", "density", "links", "link_tags", "name", "own", "parent", "sum", "tags")

    def __init__(self, name: str, attrs: str, parent):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []


def parse(page: str) -> Node:
    """A forgiving tree: children are nodes and strings; text is decoded, comments are dropped."""
    root = Node("html", "", None)
    at, here, end = 0, root, len(page)
    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            here.children.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at, name = m.end(), m[2]
        if not name or not m[4] and at >= end:
            continue
        name = name.lower()
        if m[1]:
            node = here
            while node and node.name != name:
                node = None if node.name in SCOPE and name not in SCOPE and name not in ("body", "article", "main", "section", "div") else node.parent
            if node:
                here = node.parent or root
            continue
        if name in ("html", "body") and (name == "html" or any(n.name == "body" for n in _path(here))):
            continue
        if name in ENDS_P:
            node = here
            while node and node.name != "p" and node.name not in SCOPE:
                node = node.parent
            if node and node.name == "p":
                here = node.parent
        if name in CLOSES:
            closed, limit = CLOSES[name]
            node, last = here, None
            while node and node.name not in limit:
                if node.name in closed:
                    last = node
                node = node.parent
            if last:
                here = last.parent
        if name in HEADINGS and here.name in HEADINGS:
            here = here.parent
        node = Node(name, m[3], here)
        here.children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            body = page[at : close.start() if close else end]
            if name in ("title", "textarea"):
                node.children.append(entities.unescape(body))
            at = close.end() if close else end
        elif name not in VOID and not m[3].endswith("/"):
            here = node
        elif name not in VOID:
            here = node if name not in ("svg", "path") else here
    return root


def _path(node):
    while node:
        yield node
        node = node.parent


def unwanted(node: Node, inside: bool, wraps: bool = False, names: bool = True) -> bool:
    """Dropped by name, by attributes, or as a page head; inside: under an article or main; wraps: its class, id and being a form don't count."""
    name = node.name
    if name in DROPPED:
        return True
    if name == "form" and not wraps:
        return True
    if name == "header":
        return not (inside and any(isinstance(c, Node) and c.name in HEADINGS for c in walk(node)))
    if not node.attrs or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in ATTRIBUTE.findall(node.attrs):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and names and not wraps and NAMED.search(QUALIFIED.sub("", value)):
            return True
        if key == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def walk(node: Node):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        if isinstance(n, Node):
            stack.extend(reversed(n.children))


def contents(root: Node) -> None:
    """Unlinked characters, articles with mains, and mains of every subtree: chars, tags and link_tags until measure."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        stack.extend((c, link or c.name == "a") for c in node.children if isinstance(c, Node))
    for node, link in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node)]
        node.chars = sum(c.chars for c in inner) + (0 if link else sum(len(SPACE.sub("", c)) for c in node.children if isinstance(c, str)))
        node.tags = sum(c.tags for c in inner) + (node.name in ("article", "main"))
        node.link_tags = sum(c.link_tags for c in inner) + (node.name == "main")
        if node.name in DROPPED:
            node.chars = node.tags = node.link_tags = 0


def prune(root: Node) -> None:
    """Drop what is unwanted; where names would drop nearly all text, without them."""
    contents(root)
    text, articles = root.chars, root.tags
    for names in (True, False):
        gone: list[tuple[Node, list]] = []
        stack = [(root, 0)]
        while stack:
            node, above = stack.pop()  # above: articles and mains around its children
            above += node.name in ("article", "main")

            def wraps(c):
                return bool(c.link_tags or c.tags and c.tags == articles or 2 * c.chars > text and c.tags + above == articles)

            keep = [c for c in node.children if not isinstance(c, Node) or not unwanted(c, above > 0, wraps(c), names)]
            if len(keep) < len(node.children):
                gone.append((node, node.children))
                node.children = keep
            stack.extend((c, above) for c in node.children if isinstance(c, Node))
        left = sum(len(SPACE.sub("", c)) for c in walk(root) if isinstance(c, str))
        if not names or 20 * left >= text:
            return
        for node, children in gone:
            node.children = children


def measure(body: Node) -> list[Node]:
    """Counts, densities and sums of all blocks of the body, children before parents."""
    order, stack = [], [(body, False)]
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        stack.extend((c, link or c.name == "a") for c in node.children if isinstance(c, Node))
    order.reverse()
    for node, link in order:
        node.chars = node.links = node.tags = node.link_tags = 0
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.links += c.links
                node.tags += c.tags + 1
                node.link_tags += c.link_tags + (link or c.name == "a")
            else:
                n = len(SPACE.sub("", c))
                node.chars += n
                node.links += n if link else 0
    share = body.links / body.chars if body.chars else 0.0

    def density(c: int, t: int, linked: int, link_tags: int) -> float:
        if not c:
            return 0.0
        t, plain = max(1, t), max(1, c - linked)
        base = math.log(c / plain * linked + share * c + math.e)
        rise = c / max(1, linked) * t / max(1, link_tags)
        return c / t * (math.log(rise) / math.log(base) if base > 1 and math.log(base) > 1e-9 else math.log(max(1.0, rise) + 1))

    for node, link in order:
        node.density = density(node.chars, node.tags, node.links, node.link_tags)
        # blocks by themselves; the node's own text with its inline elements as one more; blocks inside inline elements count where they stand
        node.sum, own = 0.0, [0, 0, 0, 0]
        for c in node.children:
            if not isinstance(c, Node):
                n = len(SPACE.sub("", c))
                part = [n, 0, n if link else 0, 0]
            elif c.name in BLOCK:
                node.sum += c.density
                continue
            else:
                node.sum += c.sum
                part = [c.own[0], c.own[1] + 1, c.own[2], c.own[3] + (link or c.name == "a")]
            own = [x + y for x, y in zip(own, part, strict=True)]
        node.own = own
        if node.name in BLOCK or node is body:
            node.sum += density(*own)
    return [n for n, _ in order if n.name in BLOCK or n is body]


def class_of(node: Node) -> str:
    return next((a or b or c for key, a, b, c in ATTRIBUTE.findall(node.attrs) if key.lower() == "class"), "")


def main_node(root: Node, tie_break: bool = True) -> Node | None:
    body = next((n for n in walk(root) if isinstance(n, Node) and n.name == "body"), root)
    nodes = measure(body)
    if not body.chars:
        return None
    inside = [n for n in _path(body)][1:]
    best = max(reversed(nodes), key=lambda n: n.sum)  # document order decides ties
    threshold = min(n.density for n in _path(best) if n not in inside and n.name in BLOCK or n is body)
    good = [n for n in reversed(nodes) if n.density >= threshold]
    main = max(good, key=lambda n: n.sum, default=best)
    here = main
    while here is not body and here.parent is not body and here.parent not in inside:
        others = [c for c in here.parent.children if isinstance(c, Node) and c is not here and c.name in BLOCK and c.chars]
        beside = sum(c.chars - c.links for c in others if c.density >= threshold)
        kind = (here.name, class_of(here))
        sister = (kind[1] or kind[0] in ("section", "article")) and any(2 * c.links <= c.chars and (c.name, class_of(c)) == kind for c in others)
        here = here.parent
        if sister or beside >= WIDER * (main.chars - main.links):
            main = here
    for n in _path(main) if tie_break else ():  # the part that holds most of an article stands for the whole of it
        if n.name in ("article", "main"):
            return n if 2 * (main.chars - main.links) > n.chars - n.links else main
    return main


def blocks(node: Node) -> list[str]:
    """The text of each block in page order, white space folded."""
    out: list[list[str]] = [[]]
    stack: list = [node]
    while stack:
        n = stack.pop()
        if n is None:
            out.append([])
        elif isinstance(n, str):
            out[-1].append(n)
        elif n.name == "br":
            out[-1].append(" ")
        else:
            edge = n.name in BLOCK
            if edge:
                out.append([])
                stack.append(None)
            stack.extend(reversed(n.children))
    texts = (SPACE.sub(" ", "".join(x)).strip() for x in out)
    return [x for x in texts if x]


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    node = main_node(root)
    return "\n\n".join(blocks(node)) if node else ""


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, then text."""
    ship(pages.sparkSession)
    keep = list(keep)

    def run(batches):
        for batch in batches:  # by place: a kept column may have any name
            texts = [extract(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    source = next(n for n in ("source_html", *(f"source_html_{i}" for i in range(len(keep) + 1))) if n not in keep)
    schema = ", ".join([*(f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in keep), "text string"])
    return pages.select(*keep, F.col(html).alias(source)).mapInArrow(run, schema)


def op8_html_density(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and its length in code points."""
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
