"""The parse of a page as data: its elements as a flat table in the order of the page, built on the
standard library's tokenizer in Arrow batches. What the rules need of a page are column
expressions over that table (fields.py).

An element's subtree is the rows from its own to its last, so a slice of the array; its text is a
range of the page's text. above tells which kinds of elements it is inside of (KINDS, one bit
each), so no expression looks for ancestors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that close an open element of the given kinds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEAD_ONLY = frozenset("title meta link script style base noscript template".split())
HIDDEN_TEXT = frozenset(("script", "style"))
#: Open elements at most, as in browsers: deeper ones become siblings, so no page costs more than
#: so many steps for each of its elements.
MAX_OPEN = 512


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "order")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None", order: int):
        self.tag, self.attrs, self.parent, self.children, self.order = tag, attrs, parent, [], order

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None, 0)
        self.open = [self.root]
        self.held: Counter = Counter()  # open elements by name
        self.count = 0
        self.found: dict[str, list[Node]] = {"source": [], "label": []}

    def updatepos(self, i: int, j: int) -> int:
        """Nobody asks for lines and columns."""
        return j

    def _top(self) -> Node:
        return self.open[-1]

    def _ensure(self, tag: str) -> None:
        """html, head and body exist in every page, whether or not its source has them."""
        if not self.held["html"] and tag != "html":
            self._push("html", {})
        if tag in ("html", "head", "body") or self.held["body"] or self.held["frameset"]:
            return
        if self.held["head"]:
            if tag in HEAD_ONLY or any(self.held[n] for n in ("title", "script", "style", "noscript", "template")):
                return
            while self._top().tag != "html":
                self._pop()
            self._push("body", {})
        elif tag in HEAD_ONLY and not any(isinstance(c, Node) and c.tag in ("head", "body") for c in self._top().children):
            self._push("head", {})
        elif not any(isinstance(c, Node) and c.tag == "body" for c in self._top().children):
            self._push("body", {})

    def _push(self, tag: str, attrs: dict) -> Node:
        self.count += 1
        node = Node(tag, attrs, self._top(), self.count)
        node.parent.children.append(node)
        if tag in self.found:
            self.found[tag].append(node)
        if len(self.open) < MAX_OPEN or tag in ("html", "head", "body"):
            self.open.append(node)
            self.held[tag] += 1
        return node

    def _pop(self) -> None:
        self.held[self.open.pop().tag] -= 1

    def _close(self, k: int) -> None:
        while len(self.open) > k:
            self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given: dict = {}
        for k, v in attrs:
            given.setdefault(k, "" if v is None else v)
        if tag in ("html", "head", "body") and self.held[tag]:
            node = next(n for n in self.open if n.tag == tag)
            for k, v in given.items():
                node.attrs.setdefault(k, v)
            return
        self._ensure(tag)
        if tag in CLOSES_P:
            self._close_up_to({"p"}, {"button", "td", "th", "table", "body"})
        if tag in CLOSES:
            self._close_up_to(*CLOSES[tag])
        node = self._push(tag, given)
        if tag in VOID and self._top() is node:
            self._pop()

    def _close_up_to(self, kinds: set[str], stop: set[str]) -> None:
        if not any(self.held[kind] for kind in kinds):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in kinds:
                self._close(k)
                return
            if self.open[k].tag in stop or self.open[k].tag in ("html", "#document"):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or not self.held[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._close(k)
                return
            if self.open[k].tag in ("body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._ensure("#text")
        self._top().children.append(data)


_TAG_START = re.compile("<[a-zA-Z/!?]")


def parse(html: str) -> Node:
    return _built(html).root


def _built(html: str) -> _Builder:
    builder = _Builder()
    # Tags that the page's end cuts off are left out; the tokenizer would look for their end again and again.
    last = html.rfind(">") + 1
    unfinished = _TAG_START.search(html, last)
    builder.feed(html[: unfinished.start()] if unfinished else html)
    builder.close()
    return builder


def resolve(href: str, base: str) -> str | None:
    """Absolute URL, null if there is none; an empty path becomes "/"."""
    try:
        out = urljoin(base, href.strip())
        parts = urlsplit(out)
        if not parts.scheme:
            return None
        if parts.scheme in ("http", "https"):
            if not parts.netloc:
                return None
            parts = parts._replace(netloc=parts.netloc.lower(), path=parts.path or "/")
            return parts.geturl()
        return out
    except ValueError:
        return None


def host(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


#: Kinds of elements, as bits of own (what an element is) and above (what it is inside of).
HEAD, LABEL, PICTURE, CONCEALED, AREA, CHROME, BESIDE, ORDERED, BULLETS, MODERN, NAMED = (1 << k for k in range(11))
_OF_TAG = {"head": HEAD, "label": LABEL, "picture": PICTURE, "dialog": CONCEALED, "article": AREA, "main": AREA, "ol": ORDERED, "ul": BULLETS}
_OF_TAG |= dict.fromkeys(("nav", "header", "footer", "aside", "script", "style"), CHROME | BESIDE) | {"noscript": BESIDE}
_OF_ROLE = {"dialog": CONCEALED, "alertdialog": CONCEALED, "main": AREA} | dict.fromkeys(("navigation", "banner", "contentinfo"), CHROME | BESIDE)
_OF_CLASS = {"content": AREA} | dict.fromkeys("nav navigation header footer sidebar menu cookie-banner cookie-notice".split(), BESIDE)
_MODERN = re.compile(r"\.(webp|avif)(\?|$)", re.I)
ICONS = ("icon", "shortcut icon", "apple-touch-icon")

NODE = (
    "struct<n: int, tag: string, attrs: map<string, string>, parent: int, last: int, depth: int, own: int, above: int, "
    "t0: int, t1: int, body: string, url: string>"
)
#: n counts from 1 in the order of the page, parent is 0 for the outermost; t0 and t1 are bytes of
#: text, which leaves out scripts and styles: these have a body. url is the address that a link names.
TREE = f"struct<nodes: array<{NODE}>, text: binary>"
_KINDS = [("n", pa.int32()), ("tag", pa.string()), ("attrs", None), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("own", pa.int32()), ("above", pa.int32()), ("t0", pa.int32()), ("t1", pa.int32()), ("body", pa.string()), ("url", pa.string())]


def is_modern(source: Node) -> bool:
    """Whether a source element offers an image of a modern format."""
    return bool(re.search("webp|avif", source.get("type") or "", re.I) or _MODERN.search(source.get("srcset") or ""))


def _kinds(tag: str, attrs: dict) -> int:
    own = _OF_TAG.get(tag, 0)
    if not attrs:
        return own
    own |= _OF_ROLE.get(attrs.get("role"), 0)
    if names := attrs.get("class"):
        for name in names.split():
            own |= _OF_CLASS.get(name, 0)
    return own | (CONCEALED if attrs.get("aria-hidden") == "true" else 0)


class Table:
    """The elements of the pages of a batch, column by column."""

    def __init__(self) -> None:
        self.rows: list[list] = []  # as _KINDS, without attrs
        self.names: list[str] = []
        self.values: list[str] = []
        self.attrs, self.pages, self.texts = [0], [0], []

    def add(self, url: str, html: str) -> None:
        built = _built(html)
        root, rows = built.root, self.rows
        base = len(rows)
        text: list[bytes] = []
        size = 0
        modern = {id(a) for n in built.found["source"] if is_modern(n) for a in _outside(n) if a.tag == "picture"}
        named = {n.get("for") for n in built.found["label"] if n.get("for")}
        stack: list = [(root, iter(root.children), 0)]
        while stack:
            node, rest, above = stack[-1]
            for child in rest:
                if isinstance(child, str):
                    if node.tag not in HIDDEN_TEXT:
                        text.append(child.encode("utf-8", "replace"))
                        size += len(text[-1])
                    continue
                tag, attrs = child.tag, child.attrs
                own = _kinds(tag, attrs) | (MODERN if modern and id(child) in modern else 0) | (NAMED if named and tag == "input" and attrs.get("id") and attrs["id"] in named else 0)
                href = attrs.get("href") if tag == "a" or (tag == "link" and attrs.get("rel") in ICONS) else None
                body = "".join(c for c in child.children if isinstance(c, str)) if tag in HIDDEN_TEXT else None
                rows.append([child.order, tag, node.order, 0, len(stack) - 1, own, above, size, 0, body, resolve(href, url) if href else None])
                self.names += attrs
                self.values += attrs.values()
                self.attrs.append(len(self.names))
                stack.append((child, iter(child.children), above | own))
                break
            else:
                stack.pop()
                if node is not root:
                    row = rows[base + node.order - 1]
                    row[3], row[8] = len(rows) - base, size  # last, t1
        self.pages.append(len(rows))
        self.texts.append(b"".join(text))

    def arrow(self) -> pa.StructArray:
        attrs = pa.MapArray.from_arrays(pa.array(self.attrs, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))
        made = iter(zip(*self.rows)) if self.rows else iter([()] * len(_KINDS))
        columns = [attrs if kind is None else pa.array(next(made), kind) for _, kind in _KINDS]
        nodes = pa.StructArray.from_arrays(columns, [name for name, _ in _KINDS])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(self.pages, pa.int32()), nodes), pa.array(self.texts, pa.binary())], ["nodes", "text"])


def _outside(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node
