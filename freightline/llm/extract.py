"""Main text of web pages by tree scoring.

A lenient parser builds the element tree.  Elements that cannot be article text (navigation, page
footers, scripts, styles, embedded media) are marked with all they hold.  Page headers, asides, forms,
and classes, ids or roles that name adverts, notices, menus, sharing bars or reader comments are only
evidence: they are marked too, unless the page's text lies in them and next to none outside, as in a
body wrapper with such a class or a form around the whole page.
Every paragraph earns points for its length and commas and passes them to its ancestors: all to
the parent, half to the grandparent, less further up.  Scores are discounted by link density.  The
best container is kept, raised to the enclosing article or main element if there is one, with those
siblings that score well or read like text.

Defined cases: null or empty html gives an empty text; unclosed tags, comments and quotes end at
the latest with the page; a page without paragraphs gives its unmarked text outside link lists;
ties go to the first container; of several articles on a page the one with the best container is the
main text; time is linear in the page, also without closing signs or with deep nesting; repeated rows give repeated results.
"""
from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("script style noscript iframe noembed noframes title head nav footer button select option "
                    "textarea input label svg canvas audio video object embed template menu map xmp".split())
#: Dropped as well, unless the page's text lies in them.
SUSPECT = frozenset("aside form dialog".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary "
                   "table tbody td tfoot th thead title tr ul br option".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "head", "html", "body", "option", "title"}
#: An open element of the key's name ends where one of these starts, up to the barrier.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
        "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NAMED = re.compile(r"(?:^|[\s_-])(ad|ads|adv|advert\w*|adsense|banner|breadcrumbs?|byline-ads|comments?|commentlist|cookies?|consent|"
                   r"disclaimer|disqus|foot|footer|gdpr|head|header|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|"
                   r"notification|alert|overlay|pager|pagination|popup|promo|promotion|promoted|related|recommend\w*|"
                   r"replies|reply|respond|share|sharing|sidebar|sidenav|signup|login|skip|social|sponsor\w*|subscribe|"
                   r"subscription|tags|teaser|toolbar|topbar|widget)s?(?:$|[\s_-])", re.I)
#: Class names that only say what a page has or how it looks.
MANNER = re.compile(r"(?:has|no|not|is|with|without)[-_]|.*[-_](?:with|without)[-_]|.*[-_](?:open|closed|fixed|sticky|enabled|disabled|on|off|left|right)$", re.I)
REMARKS = re.compile(r"comment|disqus|repl|respond", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
SAFE = frozenset(("html", "body", "article", "main"))
PARAGRAPHS = frozenset("p pre blockquote dd td li".split())
SCORED = frozenset("div section article main body center td blockquote html".split())


class Node:
    __slots__ = ("name", "parent", "children", "mark", "marked", "linked", "chars", "link_chars", "links", "paragraphs",
                 "commas", "score")

    def __init__(self, name: str, parent: Node | None, mark: int):
        self.name, self.parent, self.children, self.mark = name, parent, [], mark
        self.marked = False
        self.linked = name == "a" or (parent is not None and parent.linked)
        self.chars = self.link_chars = self.links = self.paragraphs = self.commas = 0
        self.score = 0.0

    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0


#: Marks of an element: never article text; named like something else; named like readers' comments.
CERTAIN, NAMED_SO, REMARK = 3, 1, 2


def mark_of(name: str, attributes: str, inside_article: bool) -> int:
    if name in DROPPED:
        return CERTAIN
    mark = NAMED_SO if name in SUSPECT or (name == "header" and not inside_article) else 0
    if not attributes or name in SAFE:
        return mark
    low = attributes.lower()
    if not any(k in low for k in ("class", "id", "role", "hidden", "display")):
        return mark
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    for word in f"{values.get('class', '')} {values.get('id', '')}".split():
        if (found := NAMED.search(word)) and not MANNER.match(word):
            mark = max(mark, REMARK if REMARKS.match(found[1]) else NAMED_SO)
    if (values.get("role", "").lower() in ROLES or values.get("aria-hidden", "").lower() == "true"
            or re.search(r"(?:^|\s)hidden(?:\s|$|=)", low) or "display:none" in values.get("style", "").lower().replace(" ", "")):
        mark = max(mark, NAMED_SO)
    return mark


class Tags:
    """Ends of tags, in time linear in the page: a quote that is not closed is a character, and once
    quotes have swallowed every ``>`` to the page's end, they are characters from there on."""

    def __init__(self, page: str):
        self.page, self.open = page, set()

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``; -1 if there is none."""
        first = at
        while m := STOP.search(self.page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            if m[0] not in self.open:
                close = self.page.find(m[0], at)
                if close < 0:
                    self.open.add(m[0])
                else:
                    at = close + 1
        self.open |= {'"', "'"}
        return self.page.find(">", first)


def parse(page: str) -> list[Node]:
    """All nodes in document order, the root first."""
    root = Node("html", None, 0)
    nodes, stack, at, n = [root], [root], 0, len(page)
    opened = Counter(["html"])
    tags, no_end = Tags(page), False

    def close_to(depth: int) -> None:
        for x in stack[depth:]:
            opened[x.name] -= 1
        del stack[depth:]

    def add_text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    while at < n:
        start = page.find("<", at)
        if start < 0 or start == n - 1:
            add_text(page[at:])
            break
        if page[start + 1] in "!?":
            add_text(page[at:start])
            if page.startswith("<!--", start):
                end = COMMENT_END.search(page, start + 4)
                at = end.end() if end else n
            else:
                at = page.find(">", start) + 1 or n
            continue
        m = NAME.match(page, start + 1)
        end = tags.end(m.end()) if m and not no_end else -1
        if m and end < 0:  # a tag that the page's end cuts off: the last one goes, what stands before it is text
            no_end = True
            last = max(page.rfind(c + x, start) for c in "<" for x in ("/", ""))
            cut = re.compile("<[a-zA-Z/]").match(page, last)
            add_text(page[at:last] if cut else page[at:])
            break
        if not m:
            add_text(page[at:start + 1])
            at = start + 1
            continue
        add_text(page[at:start])
        attributes, at = page[m.end():end], end + 1
        name = m[2].lower()
        if m[1]:
            if name in ("html", "body") or not opened[name]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close_to(i)
                    break
            continue
        if name == "html":
            continue
        if name in ENDS_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close_to(i)
                    break
                if stack[i].name in BLOCKS:
                    break
        if name in ENDS and any(opened[x] for x in ENDS[name][0].split()):
            names, barrier = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in barrier:
                    break
                if stack[i].name in names.split():
                    close_to(i)
                    break
        node = Node(name, stack[-1], mark_of(name, attributes, bool(opened["article"] or opened["main"])))
        stack[-1].children.append(node)
        nodes.append(node)
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
            if close is None:
                break
            at = page.find(">", close.start()) + 1 or n
        elif name not in VOID and (not attributes.rstrip().endswith("/")
                                   or name in ("p", "div", "span", "a", "b", "i", "section", "article")):
            stack.append(node)  # a slash does not close these
            opened[name] += 1
    return nodes


#: A named element is no wrapper of the article if the page has so much of its text outside marked ones.
OUTSIDE, WITHIN = 0.1, 0.5


def settle_marks(nodes: list[Node]) -> None:
    """Decide which marks hold.  Certain ones do.  A name is only evidence: an element that holds most of
    the page's text, while next to none lies outside marked elements, is the wrapper of the article and
    keeps it; one named like comments only if it also holds an article, a main element or a first heading."""
    body: dict[int, int] = {}  # text outside certain marks
    free: dict[int, int] = {}  # text outside all marks below
    holds: set[int] = set()
    for x in reversed(nodes):
        own = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        inner = [c for c in x.children if isinstance(c, Node)]
        body[id(x)] = 0 if x.mark == CERTAIN else own + sum(body[id(c)] for c in inner)
        free[id(x)] = own + sum(free[id(c)] for c in inner if not c.mark)
        if any((c.name in ("article", "main", "h1") and not c.mark) or id(c) in holds for c in inner if c.mark != CERTAIN):
            holds.add(id(x))
    page = body[id(nodes[0])]
    outside = free[id(nodes[0])]
    for x in nodes:
        if (up := x.parent) is not None and up.marked:
            x.marked = True
        elif x.mark:
            wrapper = (x.mark != CERTAIN and body[id(x)] >= WITHIN * page > 0 and outside < OUTSIDE * page
                       and (x.mark != REMARK or id(x) in holds))
            x.marked = not wrapper
            outside += free[id(x)] if wrapper else 0


def measure(nodes: list[Node]) -> None:
    """Text and link characters below each node, then points of the paragraphs."""
    loose: dict[int, tuple[int, int]] = {}
    for node in reversed(nodes):
        if node.marked:
            continue
        text = " ".join("".join(c for c in node.children if isinstance(c, str)).split())
        loose[id(node)] = len(text), text.count(",")
        node.chars += len(text)
        node.commas += text.count(",")
        node.link_chars += len(text) if node.linked else 0
        node.links += node.name == "a"
        node.paragraphs += node.name == "p" and node.chars - node.link_chars > 0
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.commas += node.commas
            up.link_chars += node.link_chars
            up.links += node.links
            up.paragraphs += node.paragraphs
    for node in nodes:
        if node.marked:
            continue
        paragraph = node.name in PARAGRAPHS
        if not (paragraph or node.name in SCORED):
            continue
        chars, commas = (node.chars, node.commas) if paragraph else loose[id(node)]
        if not chars or (paragraph and is_link_list(node)):
            continue
        points = (1 + commas + min(chars / 100, 3)) * (1 - node.density())
        if not paragraph:
            node.score += points
        share, up = 1.0, node.parent
        for level in range(1, 6):
            if up is None:
                break
            up.score += points * share
            up, share = up.parent, 0.5 if level == 1 else 1 / (3 * level)


def is_link_list(node: Node) -> bool:
    return node.name in ("ul", "ol", "div", "table", "section", "dl") and node.links >= 3 and not node.paragraphs and node.density() > 0.6


def text_of(kept: list[Node]) -> str:
    """Text of kept nodes in page order: blocks joined by one space."""
    out: list[str] = []
    stack: list = list(reversed(kept))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.marked and not is_link_list(x):
            if x.name in BLOCKS:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def readable(node: Node) -> bool:
    """A sibling that reads like text: a heading, or a paragraph with few links."""
    return (node.name in ("h1", "h2", "h3") or node.name in ("p", "blockquote", "pre", "ul", "ol")) and node.density() < 0.25


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = parse(page)
    settle_marks(nodes)
    measure(nodes)
    held = [x for x in nodes if not x.marked and x.score > 0]
    if not held:
        return text_of(nodes[:1])
    worth = {id(x): x.score * (1 - x.density()) for x in held}
    best = max(held, key=lambda x: worth[id(x)])  # the first of equals
    up = best
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    if up is not None:
        return text_of([up])
    if best.parent is None:
        return text_of([best])
    limit = 0.2 * worth[id(best)]
    siblings = [x for x in best.parent.children if isinstance(x, Node) and not x.marked]
    return text_of([x for x in siblings if x is best or worth.get(id(x), 0) >= max(limit, 1) or readable(x)])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Append ``text`` and ``n_chars`` to pages with an ``html`` column; no row moves."""

    def run(pages_):
        texts = [main_text(p) for p in pages_]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return append_columns(pages, run, [("text", T.StringType()), ("n_chars", T.LongType())], ["html"])


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
