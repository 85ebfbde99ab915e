"""The main text of web pages by composite text density.

A page becomes a tree of its block elements (tag soup is read as browsers read it: implied ends, void elements, raw text).
For every node: characters, tags, characters in links and link tags, from which comes the composite density, characters
per tag adjusted for links. A node's density sum is that of its children; the node with the greatest sum holds the
article. The least density on its way up to the body is the threshold that other subtrees have to reach to stand beside
it. What a page says of itself (elements, roles, words in class and id) takes menus, notices, adverts, forms and comments
out before densities are computed, inside the article too; an ``article`` or ``main`` element around the node with the
greatest sum is taken as a whole.

Pages are rows, each read by itself in one pass over its text: nothing is shuffled.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import bounded_batches, table

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu"
    " nav noscript ol optgroup option p pre search section summary table tbody td template tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption head html legend optgroup option tbody td template tfoot th thead tr noscript".split())
#: A start tag ends an open element of these names, unless one of the others stands between.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
CELLS = frozenset("td th caption table html template".split())
# What is no part of an article: elements, roles, and words in class and id.
ASIDE = frozenset("head script style noscript template nav aside footer form button select textarea iframe object svg math canvas audio video map dialog menu search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay"
    " ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion related recommended recommendations share sharing social newsletter subscribe"
    " subscription signup login pagination pager widget widgets toolbar copyright disclaimer form search".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies respond reply discussion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words with which a class says what a page has, lacks or allows, not what an element is.
SAYS_OF = frozenset("no not has have with without is free open opened closed enabled disabled".split())

TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)|[^>=]|=)*+)>|!--(?:>|->|.*?--!?>|.*+)|[!?/][^>]*+(?:>|\Z)|[a-zA-Z/][^>]*+\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """A block element, or a run of text in one (name ''). chars, tags, link_chars, link_tags are of the whole subtree."""

    __slots__ = ("name", "parent", "kind", "text", "chars", "tags", "link_chars", "link_tags", "children", "density", "sum")

    def __init__(self, name: str, parent: Node | None, kind: str = ""):
        self.name, self.parent, self.kind, self.text, self.children = name, parent, kind, None, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        if parent is not None:
            parent.children.append(self)


def kind_of(name: str, attributes: str) -> str:
    """'out' for what stands beside an article by its own word, 'comments', 'header', or ''."""
    if name in ASIDE:
        return "out"
    kind = "header" if name == "header" else ""
    if "=" not in attributes or name in ("html", "body"):
        return kind
    for key, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if key.lower() == "role":
            found = {value.strip().lower()} & ROLES
        else:
            found = set()
            for one in value.split():
                words = [w.lower() for w in WORD.findall(one)]
                if SAYS_OF.isdisjoint(words):
                    found.update(words)
            if found & COMMENTS:
                return "comments"
            if "header" in found and name not in HEADINGS:
                kind = kind or "header"
            found &= MARKS
        if found:
            kind = "out"
    return kind


def tree(page: str) -> list[Node]:
    """The nodes of a page in its order, from a root."""
    root = Node("html", None)
    nodes, stack, names = [root], [root], Counter({"html": 1})
    links = inline = 0  # open links, and inline tags of the run
    open_inline: list[tuple[str, str, int]] = []  # name, kind and depth of inline elements that take their text out
    run: list[str] = []
    run_tags = run_link_tags = run_link_chars = 0

    def end_run() -> None:
        nonlocal run_tags, run_link_tags, run_link_chars
        text = " ".join(references.unescape("".join(run)).split()) if run else ""
        if text:
            n = Node("", stack[-1])
            n.text, n.chars, n.tags, n.link_tags, n.link_chars = text, len(text), run_tags, run_link_tags, min(run_link_chars, len(text))
            nodes.append(n)
        run.clear()
        run_tags = run_link_tags = run_link_chars = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        end_run()
        while len(stack) > depth:
            names[stack.pop().name] -= 1
        while open_inline and open_inline[-1][2] > len(stack):
            open_inline.pop()
        links = 0

    def close(which: frozenset, limits: frozenset) -> None:
        if any(names[w] for w in which):
            last = 0
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].name in limits:
                    break
                if stack[d].name in which:
                    last = d
            if last:
                pop_to(last)

    at, size, finder = 0, len(page), TAG.search
    while at < size:
        m = finder(page, at)
        start = m.start() if m else size
        if start > at and not open_inline:
            piece = page[at:start]
            run.append(piece)
            if links:
                run_link_chars += len(" ".join(references.unescape(piece).split()))
        if not m:
            break
        at = m.end()
        ending, name, attributes = m.group(1), m.group(2), m.group(3)
        if name is None:
            continue
        name = name.lower()
        if ending:
            if name in BLOCK:
                if names[name] > (name == "html") and name not in ("html", "body"):
                    d = len(stack) - 1
                    while stack[d].name != name and not (stack[d].name in CELLS and name not in CELLS and name not in ("tr", "tbody", "thead", "tfoot")):
                        d -= 1
                    if stack[d].name == name:
                        pop_to(d)
            elif name == "a":
                links = 0
            elif open_inline and open_inline[-1][0] == name:
                open_inline.pop()
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else size
            close_tag = page.find(">", at)
            at = close_tag + 1 if stop and close_tag >= 0 else size
            continue
        if name == "br" or name in VOID and name not in BLOCK:
            run_tags += 1
            if name == "br":
                run.append(" ")
            continue
        if name not in BLOCK:
            run_tags += 1
            if name == "a":
                links, run_link_tags = 1, run_link_tags + 1
            kind = kind_of(name, attributes)
            if kind in ("out", "comments") and not (name in ("svg", "math") and attributes.endswith("/")) or open_inline and open_inline[-1][0] == name:
                open_inline.append((name, kind, len(stack)))
            continue
        if name in ("html", "body"):
            # A second one adds nothing; the first body ends the head.
            if name == "body" and not names["body"]:
                close(frozenset({"head"}), frozenset())
            else:
                continue
        elif name in ENDS:
            close(*ENDS[name])
        if name in ENDS_P and names["p"]:
            close(frozenset({"p"}), CELLS | {"button"})
        elif name in HEADINGS and stack[-1].name in HEADINGS:
            pop_to(len(stack) - 1)
        end_run()
        if open_inline:
            kind = "out"
        else:
            kind = kind_of(name, attributes)
        node = Node(name, stack[-1], kind)
        nodes.append(node)
        if name != "hr":
            stack.append(node)
            names[name] += 1
    end_run()
    return nodes


def left_out(nodes: list[Node]) -> set[int]:
    """Which nodes (by id) stand outside any article: those whose own kind says so, with all below, unless an article or
    main element stands in them. A header is left out unless it stands in an article or main element itself, or is a heading without links."""
    whole, inside, gone, titled, linked = set(), set(), set(), set(), set()
    for n in reversed(nodes):
        for found, here in ((titled, n.name == "h1"), (linked, n.link_tags > 0)):
            if (here or id(n) in found) and n.parent is not None:
                found.add(id(n.parent))
        if id(n) in whole or n.name in ("article", "main") and not n.kind:
            whole.add(id(n))
            if n.parent is not None:
                whole.add(id(n.parent))
    for n in nodes:
        up = n.parent
        if up is not None and id(up) in inside or n.name in ("article", "main"):
            inside.add(id(n))
        if up is not None and id(up) in gone:
            gone.add(id(n))
        elif n.kind == "comments":
            gone.add(id(n))
        elif n.kind == "out" and id(n) not in whole:
            gone.add(id(n))
        elif n.kind == "header" and id(n) not in whole and (up is None or id(up) not in inside) and (id(n) not in titled or id(n) in linked):
            gone.add(id(n))
    return gone


def weigh(nodes: list[Node]) -> None:
    """Counts of whole subtrees, composite densities and their sums; nodes are in the order of the page."""
    for n in reversed(nodes):
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + (n.name != "")
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
    body = nodes[0]
    share = max(body.link_chars, 1) / max(body.chars, 1)
    for n in nodes:
        if n.chars:
            tags, link_chars, plain = max(n.tags, 1), max(n.link_chars, 1), max(n.chars - n.link_chars, 1)
            base = log(n.chars / plain * link_chars + share * n.chars + e)
            n.density = n.chars / tags * log(n.chars / link_chars * tags / max(n.link_tags, 1) + 1) / log(base)
    for n in nodes:
        n.sum = sum(c.density for c in n.children) if n.name else n.density


def chosen(nodes: list[Node]) -> set[int]:
    """Ids of the nodes whose whole subtrees are the article: the one with the greatest density sum (taken up to the
    article or main element around it), and what reaches the least density on its way to the body."""
    best = max(nodes, key=lambda n: n.sum)
    if not best.chars:
        return set()
    path, threshold, around = set(), best.density, None
    n = best
    while n is not None:
        path.add(id(n))
        threshold = min(threshold, n.density)
        if n.name in ("article", "main") and (around is None or n.name == "article"):
            around = n
        n = n.parent
    named = [n for n in nodes if n.name in ("article", "main")]
    out = {id(around or best)}
    if around is not None or any(n.chars for n in named):
        # Other articles of the page that are as dense; nothing outside them.
        return out | {id(n) for n in named if n.name == "article" and n.density >= threshold}
    # By position: subtrees off the path, from the top, down to where the density is reached.
    taken = set(out)
    for n in nodes:
        up = n.parent
        if up is None or id(n) in path:
            continue
        if n.density >= threshold and id(up) in path and id(up) not in taken:
            inner = [n]
            for x in inner:
                inner.extend(x.children)
            taken.add(id(max(inner, key=lambda x: x.sum)))
        elif n.name == "h1":
            taken.add(id(n))
    return taken


def is_menu(n: Node) -> bool:
    return n.link_tags >= 3 and 10 * n.link_chars >= 9 * n.chars and n.name not in ("", "html", "body", "article", "main")


def blocks(page: str | None) -> list[str]:
    """The blocks of the main text, in the order of the page."""
    nodes = tree(page or "")
    gone = left_out(nodes)
    for n in nodes:
        n.children = [c for c in n.children if id(c) not in gone]
    nodes = [n for n in nodes if id(n) not in gone]
    if not nodes:
        return []
    weigh(nodes)
    out, inside, wanted = [], set(), chosen(nodes)
    for n in nodes:
        if (id(n) in wanted or n.parent is not None and id(n.parent) in inside) and not is_menu(n):
            inside.add(id(n))
            if not n.name:
                out.append(n.text)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of text).

    The text is the article's blocks in page order with an empty line between; within a block character references are
    decoded and white space (Unicode's, br too) is one space. Null and empty pages, and pages without text, have the empty text;
    pages cut off anywhere are read as far as they go. Repeated rows are read each by itself, page_id and url may be null.
    Columns besides page_id, url and html are not read. An empty table gives none.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = ["\n\n".join(blocks(p)) for p in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op11(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
