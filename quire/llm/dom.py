"""A small tolerant HTML parser: elements, text blocks, and the features of block-level nodes."""

from __future__ import annotations

import html as entities
import re

import numpy as np

#: A tag whose quotes close; `_tag_end` reads the others.
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
MARK = re.compile(r"[>\"']")
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")

#: Fixed values of HTML: elements without content, with content that is no text of the page, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template".split())
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
#: An element of the key tag ends at the start of these.
P_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul li dt dd td th tr tbody thead tfoot".split()
)
SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id and role attributes, by what they hint at.
HINTS = [
    "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager skip",
    "header head masthead banner logo top branding hero",
    "footer foot copyright colophon bottom legal credits",
    "sidebar side aside widget related recommended recommendations more trending popular rail secondary complementary",
    "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp outbrain taboola commercial",
    "cookie cookies consent notice gdpr alert popup modal overlay banner warning message toast dialog paywall",
    "comment comments reply replies respond discussion disqus responses feedback thread reader readers",
    "form search subscribe newsletter signup login register contact input field",
    "share sharing social follow twitter facebook tags meta byline author date",
    "article content main post entry story body text page blog news hentry maincontent document prose",
]
HINT = {}
for _k, _line in enumerate(HINTS):
    for _w in _line.split():
        HINT.setdefault(_w, []).append(_k)
TAGS = (
    "nav header footer aside form article main section div p ul ol li h1 h2 h3 h4 h5 h6 table tr td th blockquote pre "
    "figure figcaption dl dt dd body fieldset button select address details".split()
)
TAG_AT = {t: i for i, t in enumerate(TAGS)}


class Node:
    __slots__ = ("tag", "parent", "children", "hints", "parts", "order", "hidden", "depth")

    def __init__(self, tag: str, parent: Node | None, hints: tuple[int, ...] = (), hidden: bool = False):
        self.tag, self.parent, self.hints, self.hidden = tag, parent, hints, hidden
        self.depth = 0 if parent is None else parent.depth + 1
        self.children: list[Node] = []
        self.parts: list = []  # [text, linked] pieces and child nodes, in page order
        if parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


class _Open:
    """The elements that are open, with the innermost of each tag at hand; every element is closed once."""

    def __init__(self, root: Node):
        self.node = root
        self.by_tag: dict[str, list[Node]] = {root.tag: [root]}

    def enter(self, node: Node) -> None:
        self.node = node
        self.by_tag.setdefault(node.tag, []).append(node)

    def close(self, node: Node) -> None:
        """Close node and all inside it; the root stays."""
        while self.node is not node.parent and self.node.parent is not None:
            self.by_tag[self.node.tag].pop()
            self.node = self.node.parent

    def innermost(self, tags) -> Node | None:
        found = [self.by_tag[t][-1] for t in tags if self.by_tag.get(t)]
        return max(found, key=lambda x: x.depth, default=None)

    def outermost(self, tags, inside: int) -> Node | None:
        """The outermost open element of the tags that lies deeper than `inside`."""
        best = None
        for t in tags:
            for x in reversed(self.by_tag.get(t, ())):
                if x.depth <= inside:
                    break
                best = x if best is None or x.depth < best.depth else best
        return best


class _Tags:
    """Tags of a page. No quote is followed twice to find out that it does not close, so a page takes linear time."""

    def __init__(self, page: str):
        self.page, self.last, self.open_quotes = page, page.rfind(">"), None

    def at(self, start: int) -> tuple[str, str, int] | None:
        """Name, attributes and end of the tag that begins here; None if none does."""
        if start > self.last or not NAME.match(self.page, start):
            return None
        if self.open_quotes is None:
            if m := TAG.match(self.page, start):
                return m[1].lower(), m[2], m.end()
            self.open_quotes = set()  # from here on, remember
        name = NAME.match(self.page, start)
        at, seen = name.end(), []
        while m := MARK.search(self.page, at):
            if m[0] == ">":
                return name[1].lower(), self.page[name.end() : m.start()], m.end()
            if m.start() in self.open_quotes:
                break
            seen.append(m.start())
            close = self.page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.open_quotes.update(seen)
        return None


def _attributes(raw: str) -> tuple[tuple[int, ...], bool]:
    hints, hidden = [], bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", raw))
    for name, a, b, c in ATTR.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for w in SPLIT.split(value):
                hints += HINT.get(w.lower(), ())
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return tuple(hints), hidden


def parse(page: str) -> Node:
    """The tree of block-level nodes. Inline elements leave no node; their text goes to the block around them.

    Takes time in proportion to the page, whatever is unclosed, misnested or repeated in it.
    """
    root = Node("body", None)
    open_, tags = _Open(root), _Tags(page)
    links = foreign = 0  # open links of the current node; open svg and math elements
    at, n, begin = 0, len(page), 0
    closers: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()

    def text(a: int, b: int) -> None:
        if b > a:
            open_.node.parts.append((entities.unescape(page[a:b]), links > 0))

    while (lt := page.find("<", at)) >= 0:
        after = page[lt + 1 : lt + 2]
        found = tags.at(lt) if after.isascii() and (after.isalpha() or after == "/") else None
        if found is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = end + 3 if end >= 0 else n
            elif after and after in "!?/":
                end = page.find(">", lt)
                end = end + 1 if end >= 0 else n
            elif after.isascii() and after.isalpha() and page.find("<", lt + 1) < 0:
                end = n  # a tag that the page's end cuts off
            else:
                at = lt + 1
                continue
            text(begin, lt)
            begin = at = end
            continue
        text(begin, lt)
        tag, attrs, end = found
        begin = at = end
        if after == "/":
            if tag == "a":
                links = max(0, links - 1)
            elif tag in FOREIGN:
                foreign = max(0, foreign - 1)
            elif tag not in INLINE and not (foreign and tag not in P_ENDS) and open_.by_tag.get(tag):
                up = open_.by_tag[tag][-1]
                if up.parent is not None:
                    open_.close(up)
                    links = 0
            continue
        if tag == "br":
            open_.node.parts.append((" ", False))
            continue
        own_end = attrs.rstrip().endswith("/")
        if tag in RAW and not own_end:
            # what is not closed ends the page; that is looked for once a tag
            close = None if tag in unclosed else closers.setdefault(tag, re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE)).search(page, at)
            if close is None:
                unclosed.add(tag)
            begin = at = close.end() if close else n
            continue
        if tag in FOREIGN:
            foreign += not own_end
            continue
        if tag in VOID or tag in ("html", "head", "body"):
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        if foreign:
            if tag not in P_ENDS:
                continue  # an element of a formula or drawing: its text belongs to the block around it
            foreign = 0
        if tag in P_ENDS and open_.by_tag.get("p"):
            # an open p has no other such element inside it, as each would have ended it
            open_.close(open_.by_tag["p"][-1])
            links = 0
        if tag in SAME:
            close, stop = SAME[tag]
            scope = open_.innermost(stop)
            inside = scope.depth if scope is not None else -1
            last = open_.outermost(close, inside) if tag == "tr" else open_.innermost(close)
            if last is not None and last.depth > inside:
                open_.close(last)
                links = 0
        hints, hidden = _attributes(attrs) if attrs else ((), False)
        open_.enter(Node(tag, open_.node, hints, hidden))
        links = 0
    text(begin, n)
    return root


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        x.order = len(out)
        out.append(x)
        todo += reversed(x.children)
    return out


def blocks(node: Node) -> list[str]:
    """A node's own text blocks: its text between child nodes, white space turned into one space, none empty."""
    out, run = [], []
    for part in [*node.parts, None]:
        if isinstance(part, tuple):
            run.append(part[0])
        elif run:
            if joined := SPACE.sub(" ", "".join(run)).strip():
                out.append(joined)
            run = []
    return out


NUMBERS = 18
WIDTH = NUMBERS + len(TAGS) + 1 + 2 * len(HINTS) + 6


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node (in page order): density of its subtree, place among siblings, tag, attribute words."""
    m = len(nodes)
    own = np.zeros((m, 6))  # text, linked text, blocks, sentence marks, paragraphs, hints of boilerplate
    parent = np.array([x.parent.order if x.parent is not None else -1 for x in nodes])
    depth = np.zeros(m)
    out = np.zeros((m, WIDTH), np.float32)
    tag0, hint0, up0, anc0 = NUMBERS, NUMBERS + len(TAGS) + 1, NUMBERS + len(TAGS) + 1 + len(HINTS), WIDTH - 6
    for i, x in enumerate(nodes):
        for part in x.parts:
            if isinstance(part, tuple):
                t = len(part[0].strip())
                own[i, 0] += t
                own[i, 1] += t * part[1]
                own[i, 3] += part[0].count(".") + part[0].count(",")
        own[i, 2] = own[i, 0] > 0
        own[i, 4] = x.tag == "p"
        out[i, tag0 + TAG_AT.get(x.tag, len(TAGS))] = 1
        for h in x.hints:
            out[i, hint0 + h] = 1
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            out[i, up0 : up0 + len(HINTS)] = np.maximum(out[p, up0 : up0 + len(HINTS)], out[p, hint0 : hint0 + len(HINTS)])
            out[i, anc0:] = out[p, anc0:]
            if (k := _ANCESTORS.get(x.parent.tag)) is not None:
                out[i, anc0 + k] = 1
    whole = own.copy()
    size = np.ones(m)
    for i in range(m - 1, 0, -1):
        whole[parent[i]] += whole[i]
        size[parent[i]] += size[i]
    total = max(1.0, whole[0, 0])
    place, count, kin = np.zeros(m), np.ones(m), whole[:, 0].copy()
    for x in nodes:
        for k, c in enumerate(x.children):
            place[c.order], count[c.order], kin[c.order] = k, len(x.children), whole[x.order, 0]
    text = whole[:, 0]
    out[:, 0] = np.log1p(text)
    out[:, 1] = text / total
    out[:, 2] = whole[:, 1] / np.maximum(1, text)
    out[:, 3] = np.log1p(text / size)
    out[:, 4] = whole[:, 3] / np.maximum(1, text)
    out[:, 5] = np.log1p(whole[:, 4])
    out[:, 6] = depth
    out[:, 7] = place / count
    out[:, 8] = np.log1p(count)
    out[:, 9] = text / np.maximum(1, kin)
    out[:, 10] = np.log1p(own[:, 0])
    out[:, 11] = own[:, 1] / np.maximum(1, own[:, 0])
    out[:, 12] = np.arange(m) / m
    out[:, 13] = np.log1p(size)
    out[1:, 14] = np.log1p(text[parent[1:]])
    out[1:, 15] = whole[parent[1:], 1] / np.maximum(1, text[parent[1:]])
    out[:, 16] = [any("©" in t[0] for t in x.parts if isinstance(t, tuple)) for x in nodes]
    out[:, 17] = [x.hidden for x in nodes]
    return out


_ANCESTORS = {"article": 0, "main": 1, "nav": 2, "aside": 3, "footer": 4, "form": 5}
