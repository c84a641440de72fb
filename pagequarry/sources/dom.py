"""A small tolerant HTML tree on the standard library's tokenizer."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: An opening tag (key) closes an open element of these kinds.
_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul"
CLOSES = {tag: frozenset({"p"}) for tag in _BLOCKS.split()}
CLOSES |= {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "a": frozenset({"a"})}
#: Searching for an element to close stops at these.
FENCES = frozenset("html body table td th ul ol dl template svg math button object".split())


class Node:
    __slots__ = ("attrs", "children", "foreign", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs=(), parent=None, text: str = ""):
        self.tag, self.parent, self.text = tag, parent, text
        self.attrs: dict[str, str] = {}
        for key, value in attrs:
            self.attrs.setdefault(key, value or "")
        self.children: list[Node] = []
        self.foreign = parent is not None and (parent.foreign or parent.tag in ("svg", "math"))

    def walk(self, into=lambda node: True):
        """Nodes in document order; children only where ``into`` holds."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if into(node):
                stack.extend(reversed(node.children))

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html = Node("html", (), self.root)
        self.head, self.body = Node("head", (), self.html), None
        self.html.children.append(self.head)
        self.root.children.append(self.html)
        self.open = [self.html, self.head]

    def _enter_body(self) -> None:
        if self.body is None:
            self.body = Node("body", (), self.html)
            self.html.children.append(self.body)
            self.open = [self.html, self.body]

    def _in_head(self) -> bool:
        return self.body is None

    def handle_starttag(self, tag, attrs):
        if self.open[-1].tag in ("title", "textarea"):
            self._text(self.get_starttag_text() or "")
            return
        if tag == "html":
            for key, value in attrs:
                self.html.attrs.setdefault(key, value or "")
            return
        if tag == "head":
            return
        if tag == "body":
            self._enter_body()
            for key, value in attrs:
                self.body.attrs.setdefault(key, value or "")
            return
        if self._in_head() and tag not in HEAD_ONLY and self.open[-1] is self.head:
            self._enter_body()
        self._close_for(tag)
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].foreign and self.open[-1].tag == tag:
            self.open.pop()

    def _close_for(self, tag) -> None:
        kinds = CLOSES.get(tag)
        if not kinds:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in kinds:
                del self.open[i:]
                return
            if self.open[i].tag in FENCES:
                return

    def handle_endtag(self, tag):
        if tag == "head":
            if self._in_head():
                self.open = [self.html, self.head]
            return
        if tag in ("html", "body"):
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open) and not self._in_head():
            self.open[-1].children.append(Node("p", (), self.open[-1]))
            return
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("template", "td", "th") and tag not in ("table", "tr", "tbody"):
                return

    def _text(self, data: str) -> None:
        self.open[-1].children.append(Node(None, (), self.open[-1], data))

    def handle_data(self, data):
        if self._in_head() and self.open[-1] is self.head:
            if not data.strip():
                return
            self._enter_body()
        self._text(data)


#: Comments, scripts and styles, which have no references, or an ampersand that begins none with a semicolon.
_LONE = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1|&(?!(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);)", re.I | re.S)


def parse_html(html: str, closed: bool = False) -> Node:
    """``closed``: of character references only those with their semicolon count; HTML itself also reads ``&amp`` without."""
    builder = _Builder()
    builder.feed(_LONE.sub(lambda m: "&amp;" if m[0] == "&" else m[0], html) if closed else html)
    builder.close()
    if builder.body is None:
        builder._enter_body()
    return builder.root
