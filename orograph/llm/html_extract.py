"""Operator 2, main text of web pages by tree scoring.

A one-pass reader builds the element tree with the implied end tags of HTML.
Every paragraph passes points (one, one for each comma, up to three for its
length) to its parent and half of them to the grandparent; a container's points
are discounted by its link density. The best container and those of its
siblings that score enough are kept. Boilerplate elements by tag or role give
and hold no text; by words of a class or id alone they are dropped outside an
article, and inside it only by words that name something else than prose.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one newline.

Defined results: a null or empty page, or one without text, gives an empty
string; a page without any container falls back to its body; an attribute value
without its closing quote ends with its tag; a tag that never ends is dropped
with what follows, as browsers do. Repeated rows give equal rows; an empty table
gives an empty result. Very long pages take time in proportion to their length,
however tags nest, and the memory of one page's tree.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from orograph.llm.common import map_rows, table

#: The rest of a tag after its name: quotes count only after an equals sign.
TAIL = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
COMMENT = re.compile(r"-?>|.*?--!?>", re.S)
WHITE = re.compile(r"[\s ]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold main text.
DROPPED = RAW | frozenset("head nav footer aside form button select option datalist input menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids; whole parts between separators.
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar side nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer foot masthead header topbar toolbar share sharing social related recommended recommendations popular trending comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notification alert modal popup overlay newsletter subscribe subscription signup login search widget hidden tags taglist copyright legal".split())
PLAIN = frozenset("article content main body post entry story text".split())
#: Of BOILERPLATE, words that can name prose as well (side effects, legal history): they count only where nothing else is named beside them but layout.
AMBIGUOUS = frozenset("side legal search social popular trending tags alert hidden reply replies respond copyright promotion widget foot header notification login signup overlay".split())
LAYOUT = frozenset("site page top bottom left right global user form box bar panel wrapper wrap container inner outer area block section links link list item items button primary secondary mobile desktop sticky fixed js row col column group region module icon nav menu header footer".split())
#: First words that say what isn't there, or that something stands beside.
BESIDE = frozenset("no has with without non is".split())
#: Words that drop an element within an article too, whatever stands beside them.
NEVER_PROSE = BOILERPLATE - AMBIGUOUS
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Open elements that end where one of the key begins, unless a boundary stands between.
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "td th tr", "tbody": "td th tr", "thead": "td th tr", "tfoot": "td th tr", "td": "td th", "th": "td th", "option": "option", "optgroup": "option"}
BOUNDARY = frozenset("ul ol dl table body html article section div main".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "length", "linked", "commas", "block")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.points, self.length, self.linked, self.commas, self.block = 0.0, 0, 0, 0, False


def is_boilerplate(tag: str, attributes: str, within_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":
        return not within_article
    if not attributes or tag in ("html", "body") or tag in ("article", "main") and not within_article:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or "hidden" in found or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    return any(names_boilerplate(name, within_article) for key in ("class", "id") for name in found.get(key, "").split())


def names_boilerplate(name: str, within_article: bool) -> bool:
    """Whether a class or id (``main-menu``, ``cookieNotice``) names what isn't main text. Its words count together: ``side-effects`` is no side, ``side-bar`` is one."""
    parts = [p.lower() for p in PART.findall(name)]
    if not parts or parts[0] in BESIDE:
        return False
    if not NEVER_PROSE.isdisjoint(parts):
        return True
    return not within_article and not AMBIGUOUS.isdisjoint(parts) and all(p in AMBIGUOUS or p in LAYOUT or p.isdigit() for p in parts)


class Open:
    """The stack of open elements, with the places of each tag, of blocks and of boundaries in it."""

    def __init__(self) -> None:
        self.root = Node("#root", None, False)
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.boundaries = [0], [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)
        if node.tag in BOUNDARY:
            self.boundaries.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at this place and all within it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in BOUNDARY:
                self.boundaries.pop()

    def last(self, tag: str) -> int:
        """The innermost open place of a tag; 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def within_article(self) -> bool:
        return bool(self.last("article") or self.last("main"))

    def end(self, tag: str) -> None:
        """An end tag: it closes its element; that of an inline element only within the innermost block."""
        at = self.last(tag)
        if at and (tag in BLOCK or at > self.blocks[-1]):
            self.cut(at)

    def begin(self, tag: str) -> None:
        """What a start tag closes."""
        if tag in BLOCK and self.stack[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in ENDS:
            within = [at for t in ENDS[tag].split() for at in self.places.get(t, [])[-1:] if at > self.boundaries[-1]]
            if within:
                self.cut(min(within))


def parse(html: str, forms: bool = False) -> Node:
    """The element tree; unclosed elements end where HTML ends them. With ``forms`` a form is an element as any other, and only its fields are dropped."""
    tree = Open()
    at, end, broken = 0, len(html), False
    while at < end:
        less = html.find("<", at)
        if less < 0:
            tree.stack[-1].children.append(html[at:])
            break
        mark = html[less + 1 : less + 2]
        closing = mark == "/"
        name = NAME.match(html, less + 1 + closing)
        if not name and mark not in ("!", "?", "/"):
            tree.stack[-1].children.append(html[at : less + 1])
            at = less + 1
            continue
        if less > at:
            tree.stack[-1].children.append(html[at:less])
        if not name:
            if html.startswith("<!--", less):
                found = COMMENT.match(html, less + 4)
                at = found.end() if found else end
            else:
                stop = html.find("]]>" if html.startswith("<![CDATA[", less) else ">", less)
                at = html.find(">", stop) + 1 if stop >= 0 else end
            continue
        tail = None if broken else TAIL.match(html, name.end())
        if tail is None:
            # Quotes that take every end of a tag: from here on the first one counts.
            broken = True
            at = html.find(">", name.end()) + 1
            if not at:
                break
        else:
            at = tail.end()
        tag, attributes = name[0].lower(), html[name.end() : at - 1]
        if closing:
            tree.end(tag)
            continue
        tree.begin(tag)
        here = tree.stack[-1]
        child = Node(tag, here, here.dropped or (not (forms and tag == "form") and is_boilerplate(tag, attributes, tree.within_article())))
        here.children.append(child)
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        tree.push(child)
    return tree.root


PARAGRAPHS = frozenset("p pre blockquote td h1 h2 h3 li div section".split())


def measure(root: Node) -> None:
    """Text lengths, linked lengths and commas of every element, and points passed up by paragraphs."""
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        node, done, link = stack.pop()
        if node.dropped:
            continue
        link = link or node.tag == "a"
        if not done:
            stack.append((node, True, link))
            stack.extend((c, False, link) for c in node.children if type(c) is Node)
            continue
        for c in node.children:
            if type(c) is str:
                n = len(c) if not c.isspace() else 0
                node.length += n
                node.linked += n if link else 0
                node.commas += c.count(",") + c.count("、")
            else:
                node.length += c.length
                node.linked += c.linked
                node.commas += c.commas
                node.block |= c.block or (c.tag in BLOCK and c.length > 0)
        if node.tag in PARAGRAPHS and node.length and not node.block:
            value = (1 + node.commas + min(node.length / 100, 3)) * (1 - node.linked / node.length) * (0.25 if node.tag in ("li", "td") else 1)
            if node.parent is not None:
                node.parent.points += value
                if node.parent.parent is not None:
                    node.parent.parent.points += value / 2


def score(node: Node) -> float:
    return node.points * (1 - (node.linked / node.length if node.length else 0.0)) * (1.5 if node.tag in ("article", "main") else 1)


def heads(node: Node) -> bool:
    """Whether an element is a heading, or holds one and nothing else."""
    while node.tag not in ("h1", "h2"):
        inner = [c for c in node.children if (type(c) is Node and not c.dropped and c.length) or (type(c) is str and not c.isspace())]
        if len(inner) != 1 or type(inner[0]) is str:
            return False
        node = inner[0]
    return True


def best_nodes(root: Node) -> list[Node]:
    """The best container with its kept siblings, in page order; an enclosing article or main element stands for it."""
    best, top, stack, body = None, 0.0, [root], root
    while stack:
        node = stack.pop()
        if node.dropped:
            continue
        if node.tag == "body":
            body = node
        if (s := score(node)) > top:
            best, top = node, s
        stack.extend(c for c in reversed(node.children) if type(c) is Node)
    if best is None:
        return [body]
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best, top = up, max(top, score(up))
    if best.parent is None or best.tag == "body":
        return [best]
    kept = []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif type(c) is Node and not c.dropped and c.length:
            density = c.linked / c.length
            if score(c) >= max(2.0, 0.2 * top) or (c.tag == "p" and density < 0.25 and c.length > 80) or (heads(c) and density < 0.25):
                kept.append(c)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks within nodes, in page order."""
    out: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        text = WHITE.sub(" ", unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            out.append(text)

    for node in nodes:
        stack: list[Node | str | None] = [node]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif type(x) is str:
                pieces.append(x)
            elif x.dropped:
                continue
            elif x.tag == "br":
                pieces.append(" ")
            else:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.children))
        flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    measure(root)
    text = "\n".join(blocks(best_nodes(root)))
    if not text and "<form" in html.lower():
        # A form around the whole page.
        root = parse(html, forms=True)
        measure(root)
        text = "\n".join(blocks(best_nodes(root)))
    return text


def extract(pages: list[str | None]) -> list[tuple]:
    return [(t := main_text(p), len(t)) for p in pages]


def html_extract(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Main text of each page: a map without a shuffle."""
    return map_rows(df, extract, keys, html, "text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {"op2_html_extract": op2_html_extract}
