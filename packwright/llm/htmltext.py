"""Main-text extraction by composite text density.

The page becomes a DOM. Each node gets its composite density: characters per tag,
adjusted by the share of link characters and links (Sun, Song and Liao, SIGIR 2011); a
node's density sum adds its children's densities. The container with the largest sum is
the core of the article. The smallest density on the path from the body to it is the
threshold: other subtrees at or above it contribute the container with their own largest
sum. Where the core stands in an ``article`` or ``main``, that is taken as a whole, since
short headings and paragraphs in it have low densities but belong to the text.

Tags, roles and class names that tell of menus, adverts, forms or comments are a prior
and no verdict: a marked subtree goes only if the rest of the page has a density sum that
bears comparison with the subtree's (``PRIORS``). A wrapper around the whole article
stays, whatever it is called, and what is marked inside of it is judged in turn.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)
    |<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>
    |<(?P<odd>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes template noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body center details div dl figure main ol section table tbody td tr ul".split())
WHOLE = frozenset(("article", "main"))
#: What these hold is never shown as text.
SILENT_TAGS = frozenset(
    "audio button canvas embed head iframe input map noembed noframes noscript object script select style svg template textarea title video".split()
)
#: Kinds of marks, and how many times the density sum of everything unmarked a marked
#: subtree must have to be the article after all.
PRIORS = {"name": 3.0, "form": 3.0, "hidden": 10.0, "tag": 30.0, "role": 30.0, "comment": 30.0}
#: Characters outside of links without which nothing that is marked is an article.
LEAST_CHARS = 100
MARKED_TAGS = frozenset("aside dialog footer menu nav".split())
FORM_TAGS = frozenset("fieldset form".split())
MARKED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
MARKED_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies"
    " copyright disclaimer footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices"
    " outbrain overlay pager pagination popup promo promoted promotion recommended related search share sharing"
    " sidebar signup skip social sponsor sponsored subscribe taboola toolbar widget widgets".split()
)
COMMENT_NAMES = frozenset("comment comments discussion disqus replies reply respond".split())
#: A class with one of these words tells of something that is or isn't there: no-sidebar.
MODIFIERS = frozenset("has have hide is no non not off on show with without".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NAME = re.compile(r"[^a-z0-9]+")

#: Opening one of these ends an open element of the second set, up to one of the third.
_IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}


class Node:
    __slots__ = ("attrs", "chars", "density", "kids", "link_chars", "links", "mark", "parent", "peak", "tag", "tags", "top", "total")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.kids: list[Node | str] = []


def parse(page: str) -> Node:
    """A forgiving DOM: unclosed paragraphs, items and inline tags end where they must."""
    root = Node("html", None)
    stack = [root]
    opened: Counter[str] = Counter()  # by tag, so that an end tag without a start costs no search
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            stack[-1].kids.append(page[at:upto])
        if not m:
            break
        at = m.end()
        if name := m["tag"] or m["odd"]:
            name, attrs = name.lower(), m["attrs"] or ""
            if name in ("html", "body") and any(n.tag == name and (n is not root or n.attrs) for n in stack):
                continue
            if name == "html":
                root.attrs = attrs or " "
                continue
            if name in BLOCK:
                _close(stack, opened, frozenset(("p",)), CONTAINERS)
            if name in _IMPLIED:
                _close(stack, opened, *_IMPLIED[name])
            node = Node(name, stack[-1], attrs)
            stack[-1].kids.append(node)
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                upto = stop.start() if stop else end
                if name == "textarea" or name == "title":
                    node.kids.append(page[at:upto])
                at = stop.end() if stop else end
            elif name not in VOID and not attrs.endswith("/"):
                stack.append(node)
                opened[name] += 1
        elif name := m["end"]:
            name = name.lower()
            _close(stack, opened, frozenset((name,)), frozenset() if name in BLOCK else BLOCK)
    return root


def _close(stack: list[Node], opened: Counter[str], tags: frozenset[str], scope: frozenset[str]) -> None:
    """End the innermost open element of ``tags``, unless one of ``scope`` is further in."""
    if not any(opened[t] for t in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            opened.subtract(n.tag for n in stack[i:])
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def _below(node: Node) -> Iterator[Node]:
    """All nodes of a subtree, parents first."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(k for k in reversed(n.kids) if not isinstance(k, str))


def _mark(node: Node, inside_article: bool) -> str | None:
    """The kind of mark that a node's tag, role, style or names put on it."""
    if node.tag in MARKED_TAGS or (node.tag == "header" and not inside_article):
        return "tag"
    if node.tag in FORM_TAGS:
        return "form"
    if not node.attrs or node.tag in ("html", "body"):
        return None
    found = set()
    for m in _ATTR.finditer(node.attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            found.add("hidden")
        elif name == "role" and value.strip().lower() in MARKED_ROLES:
            found.add("role")
        elif name in ("class", "id"):
            for part in value.split():
                words = set(_NAME.split(_CAMEL.sub(" ", part).lower()))
                if not words & MODIFIERS:
                    if words & COMMENT_NAMES:
                        found.add("comment")
                    elif words & MARKED_NAMES or ("header" in words and not inside_article):
                        found.add("name")
    return max(found, key=lambda k: (PRIORS[k], k), default=None)


def prune(root: Node) -> None:
    """Take out what is never text, then the marked subtrees that aren't the article.

    The marked subtrees that no other one holds are looked at in the order of their
    largest density sums. One that outweighs all that is unmarked by its kind's factor
    is unmarked, and those that it holds are looked at as well; the others go.
    """
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        node.mark = None if node is root else _mark(node, inside)
        inside = inside or node.tag in WHOLE
        node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in SILENT_TAGS]
        todo.extend((k, inside) for k in node.kids if not isinstance(k, str))
    measure(root)
    order = list(_below(root))
    for n in reversed(order):
        kids = [k for k in n.kids if not isinstance(k, str)]
        # The largest sum in the subtree, with everything marked that it holds left out and counted in.
        own = max(n.density if n.chars else 0.0, sum(k.density for k in kids if not k.mark))
        free = max([own, *(k.peak[0] for k in kids if not k.mark)])
        n.peak = free, max([free, n.total, *(k.peak[1] for k in kids)])
    free, waiting = root.peak[0], _outermost_marked(root)
    heap = [(-n.peak[1] / PRIORS[n.mark], i, n) for i, n in enumerate(waiting)]
    heapq.heapify(heap)
    count = len(heap)
    # The root's own density counts what is marked too: what counts is the text that is left.
    left = root.chars - sum(n.chars for n in waiting)
    if not left:
        free = 0.0
    while heap:
        worth, _, n = heapq.heappop(heap)
        if -worth <= free:
            break
        if n.chars - n.link_chars < LEAST_CHARS:
            continue
        n.mark = None
        inner = _outermost_marked(n)
        if n.chars > sum(k.chars for k in inner):
            free = max(free, n.peak[0])
        for k in inner:
            heapq.heappush(heap, (-k.peak[1] / PRIORS[k.mark], count, k))
            count += 1
    kept = [root]
    while kept:
        n = kept.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or not k.mark]
        kept.extend(k for k in n.kids if not isinstance(k, str))


def _outermost_marked(node: Node) -> list[Node]:
    """The marked nodes below a node that no marked node between holds."""
    out, todo = [], [k for k in node.kids if not isinstance(k, str)]
    while todo:
        n = todo.pop()
        if n.mark:
            out.append(n)
        else:
            todo.extend(k for k in n.kids if not isinstance(k, str))
    return out


def measure(root: Node) -> None:
    """Characters, tags, link characters, links, density and density sum of all nodes."""
    order = list(_below(root))
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.links = 0
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len("".join(k.split()))
            else:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.links += k.links + (k.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    share = root.link_chars / max(1, root.chars)
    for n in reversed(order):
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.links)
        if not c:
            n.density = 0.0
        else:
            base = math.log(c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e)
            n.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 1e-9) if base > 1 + 1e-9 else c / t
        n.total = sum(k.density for k in n.kids if not isinstance(k, str))


def _tops(order: list[Node]) -> None:
    """For every node the container with the largest density sum in its subtree, the
    first of ties; a node without any is its own."""
    for n in reversed(order):
        best = n if n.tag in CONTAINERS and n.chars else None
        for k in n.kids:
            if not isinstance(k, str) and k.top is not None and (best is None or k.top.total > best.total):
                best = k.top
        n.top = best


def select(root: Node) -> tuple[list[Node], list[Node]]:
    """The chosen subtrees, and subtrees in them that are left out."""
    order = list(_below(root))
    _tops(order)
    body = next((n for n in order if n.tag == "body"), root)
    core = body.top or body
    threshold, n, outer = core.density, core, None
    while n is not None:
        if n.tag in WHOLE:
            outer = n
        if n is body:
            break
        threshold = min(threshold, n.density)
        n = n.parent
    threshold = min(threshold, body.density)
    chosen = {id(x): x for x in (outer or core,)}
    # Around each node: the outermost article or main, and whether an article holds it.
    left_out: list[Node] = []
    path = set()
    n = core
    while n is not None:
        path.add(id(n))
        n = n.parent
    todo: list[tuple[Node, Node | None, bool]] = [(body, None, False)]
    while todo:
        n, whole, held = todo.pop()
        if n.tag == "article" and held and id(n) not in path and not _holds(core, n):
            left_out.append(n)  # an article within an article is a comment on it
            continue
        whole = whole or (n if n.tag in WHOLE else None)
        held = held or n.tag == "article"
        if n.tag in BLOCK and n.chars and n.density >= threshold:
            # Where the core stands in an article, nothing outside of articles is text.
            if whole is not None:
                chosen[id(whole)] = whole
            elif outer is None:
                found = n.top or n
                chosen[id(found)] = found
        todo.extend((k, whole, held) for k in n.kids if not isinstance(k, str))
    return list(chosen.values()), left_out


def _holds(node: Node, below: Node) -> bool:
    """Whether ``below`` stands in node and node is no article itself."""
    return node.tag != "article" and any(k is below for k in node.kids)


def render(root: Node, chosen: list[Node], left_out: list[Node]) -> str:
    """The text of the chosen subtrees in page order, block by block."""
    marked, gone = {id(n) for n in chosen}, {id(n) for n in left_out}
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = "".join(run)
            run.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append(text)

    todo: list[tuple[Node | str | None, bool]] = [(root, False)]
    while todo:
        n, inside = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            if inside:
                run.append(n)
        elif id(n) not in gone:
            inside = inside or id(n) in marked
            apart = n.tag in BLOCK or n.tag == "br"
            if apart:
                flush()
                todo.append((None, inside))
            todo.extend((k, inside) for k in reversed(n.kids))
    flush()
    return " ".join(blocks)


def extract_text(page: str | None) -> str:
    """The main text of one page; empty for null, empty and textless pages."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    measure(root)
    if not root.chars:
        return ""
    return render(root, *select(root))


def extract_pages(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_name: str = "text") -> DataFrame:
    """One row a row of df: the kept columns, the main text and n_chars (code points).

    Pages are independent of each other: no shuffle, one Arrow batch at a time.
    Defined cases: a null or empty page, or one without text, gives the empty text and
    0; an unclosed or cut page is read as far as it goes; repeated rows stay; an empty
    table gives an empty result; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*batch.schema.names[:-1], "_text", "_n"])

    rows = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", _text string, _n long"
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias(text_name), F.col("_n").alias("n_chars"))
