"""HTML text to a preorder list of nodes: the one per-row helper of the package.

Covers what the documents need of the HTML5 tree rules: implied html/head/body, void and
raw-text elements, implied ends (p, li, dt/dd, option, table parts), ignored stray end
tags, closing at the end of input, and re-opening of unclosed formatting elements in later
blocks (at most three equal ones). A formatting end tag whose element holds an open block
only stops the re-opening.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption template button object".split())
TABLE_BREAK = frozenset(["html", "table", "template"])
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
CELLS = frozenset("td th caption".split())
SPECIAL_BLOCK = CLOSES_P | frozenset("body html table tbody thead tfoot tr td th caption".split())


class _Node:
    __slots__ = ("ord", "parent", "depth", "kind", "tag", "attrs", "text", "last", "nth", "nth_n", "pos", "pos_n", "prev", "kids", "open")

    def __init__(self, parent, kind, tag=None, attrs=None, text=None):
        self.parent, self.kind, self.tag, self.attrs, self.text = parent, kind, tag, attrs, text
        self.kids, self.open = [], False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node(None, "element", "html", {})
        self.head = self.body = None
        self.stack: list[_Node] = []
        self.opened: dict[str, int] = {}  # open elements by tag, so that a search for none of them ends at once
        self.active: list[tuple[str, tuple] | None] = []
        self._push(self.root)

    # --- tree edits ---

    def _push(self, node):
        self.stack.append(node)
        node.open = True
        self.opened[node.tag] = self.opened.get(node.tag, 0) + 1

    def _pop(self):
        node = self.stack.pop()
        node.open = False
        self.opened[node.tag] -= 1
        return node

    def _add(self, kind, tag=None, attrs=None, text=None):
        parent = self.stack[-1]
        node = _Node(parent, kind, tag, attrs, text)
        parent.kids.append(node)
        if kind == "element" and tag not in VOID:
            self._push(node)
        return node

    def _to_root(self):
        while len(self.stack) > 1:
            self._pop()

    def _ensure_body(self):
        if self.body is None:
            if self.head is None:
                self._open_head()
            self._to_root()
            self.body = self._add("element", "body", {})

    def _open_head(self, attrs=None):
        if self.head is None and self.body is None:
            self._to_root()
            self.head = self._add("element", "head", attrs or {})

    def _in_scope(self, tags, stop=SCOPE):
        if not any(self.opened.get(t) for t in tags):
            return False
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in stop:
                return False
        return False

    def _pop_to(self, tags):
        while len(self.stack) > 1:
            if self.stack[-1] is self.body:
                return
            node = self._pop()
            if node.tag in CELLS:
                self._clear_marker()
            if node.tag in tags:
                return

    def _reopen(self):
        """Re-open formatting elements that were cut off by the end of their block."""
        if not self.active or self.active[-1] is None:
            return
        start = len(self.active)
        while start > 0 and self.active[start - 1] is not None and not self.active[start - 1][2].open:
            start -= 1
        for i in range(start, len(self.active)):
            tag, attrs, _ = self.active[i]
            self.active[i] = (tag, attrs, self._add("element", tag, dict(attrs)))

    def _remember(self, tag, attrs, node):
        same = []
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                break
            if self.active[i][:2] == (tag, attrs):
                same.append(i)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append((tag, attrs, node))

    def _forget(self, tag):
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                return None
            if self.active[i][0] == tag:
                return self.active.pop(i)[2]
        return None

    # --- tokens ---

    def handle_starttag(self, tag, attrs):
        pairs = {}
        for k, v in attrs:
            pairs.setdefault(k, v or "")
        if tag in ("html", "body"):
            if tag == "body":
                self._ensure_body()
            target = self.root if tag == "html" else self.body
            for k, v in pairs.items():
                target.attrs.setdefault(k, v)
            return
        if tag == "head":
            self._open_head(pairs)
            return
        if self.body is None:
            if tag in HEAD_ONLY:
                self._open_head()
                if self.stack[-1] is self.root:
                    self._push(self.head)
                self._add("element", tag, pairs)
                return
            self._ensure_body()
        if tag in CLOSES_P and self._in_scope(("p",)):
            self._pop_to(("p",))
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop()
        if tag == "li" and self._in_scope(("li",), SCOPE | {"ul", "ol"}):
            self._pop_to(("li",))
        elif tag in ("dt", "dd") and self._in_scope(("dt", "dd"), SCOPE | {"dl"}):
            self._pop_to(("dt", "dd"))
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self._pop()
        elif tag in ("td", "th"):
            if self._in_scope(("td", "th"), TABLE_BREAK):
                self._pop_to(("td", "th"))
            if self.stack[-1].tag == "table":
                self._add("element", "tbody", {})
            if self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self._add("element", "tr", {})
        elif tag == "tr":
            if self._in_scope(("tr",), TABLE_BREAK):
                self._pop_to(("tr",))
            if self.stack[-1].tag == "table":
                self._add("element", "tbody", {})
        elif tag in ("tbody", "thead", "tfoot") and self._in_scope(("tbody", "thead", "tfoot"), TABLE_BREAK):
            self._pop_to(("tbody", "thead", "tfoot"))
        if tag == "a":
            old = self._forget("a")
            if old is not None and old.open:
                self._pop_to(("a",))
        if tag not in SPECIAL_BLOCK:
            self._reopen()
        node = self._add("element", tag, pairs)
        if tag in FORMATTING:
            self._remember(tag, tuple(sorted(pairs.items())), node)
        elif tag in CELLS:
            self.active.append(None)

    def _clear_marker(self):
        while self.active and self.active.pop() is not None:
            pass

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.stack[-1].tag == tag and tag in ("path", "circle", "rect", "line", "use", "polygon"):
            self._pop()

    def handle_endtag(self, tag):
        if tag == "head":
            if self.body is None:
                self._to_root()
            return
        if tag in ("html", "body"):
            return
        if tag in HEADINGS and self._in_scope(HEADINGS):
            self._pop_to(HEADINGS)
            return
        if tag == "p" and not self._in_scope(("p",)):
            self._ensure_body()
            self._add("element", "p", {})
            self._pop()
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in FORMATTING:
            node = self._forget(tag)
            if node is None or not node.open:
                return
            for above in reversed(self.stack):
                if above is node:
                    break
                if above.tag in SPECIAL_BLOCK:
                    return
            self._pop_to((tag,))
            return
        stop = TABLE_BREAK if tag in TABLE_PARTS else SCOPE
        if self._in_scope((tag,), stop - {tag}):
            self._pop_to((tag,))

    def handle_data(self, data):
        top = self.stack[-1]
        if self.body is None:
            if top is not self.root and top is not self.head:
                self._text(data)
                return
            data = data.lstrip(" \t\n\r\f")
            if not data:
                return
            self._ensure_body()
        if self.stack[-1].tag not in ("script", "style"):
            self._reopen()
        self._text(data)

    def _text(self, data):
        kids = self.stack[-1].kids
        if kids and kids[-1].kind == "text":
            kids[-1].text += data
        elif data:
            self._add("text", text=data)

    def handle_comment(self, data):
        if self.body is not None:
            self._add("comment", text=data)

    def finish(self):
        self.close()
        self._ensure_body()
        return self.root


def parse_nodes(html: str) -> list[tuple]:
    """Preorder rows: ord, parent, depth, last (end of the sub-tree), kind, tag, attrs, text, and of elements: nth and nth_n (place among and
    number of siblings of its tag), pos and pos_n (the same among all sibling elements), prev (ord of the sibling element before it)."""
    builder = _Builder()
    builder.feed(html)
    root = builder.finish()
    order: list[_Node] = []
    todo = [root]
    root.depth, root.nth, root.nth_n, root.pos, root.pos_n, root.prev = 0, 1, 1, 1, 1, None
    while todo:
        node = todo.pop()
        node.ord = len(order)
        order.append(node)
        counts: dict[str, int] = {}
        before = None
        elements = 0
        for kid in node.kids:
            kid.depth = node.depth + 1
            if kid.kind == "element":
                counts[kid.tag] = counts.get(kid.tag, 0) + 1
                elements += 1
                kid.nth, kid.pos, kid.prev, before = counts[kid.tag], elements, before, kid
        for kid in node.kids:
            if kid.kind == "element":
                kid.nth_n, kid.pos_n = counts[kid.tag], elements
        todo.extend(reversed(node.kids))
    for node in reversed(order):
        node.last = node.kids[-1].last if node.kids else node.ord
    rows = []
    for node in order:
        head = (node.ord, node.parent.ord if node.parent else None, node.depth, node.last, node.kind, node.tag)
        if node.kind == "element":
            rows.append((*head, list(node.attrs.items()), node.text, node.nth, node.nth_n, node.pos, node.pos_n, node.prev.ord if node.prev else None))
        else:
            rows.append((*head, None, node.text, None, None, None, None, None))
    for node in order:  # no cycles stay behind, so a page's memory is free at once
        node.parent = node.prev = node.kids = None
    builder.active.clear()
    return rows
