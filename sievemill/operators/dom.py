"""A small HTML tree: parsing with implied tags and open formatting, text, and CSS selection."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("title meta link script style base noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption marquee object template applet".split())
#: tag -> (open tags that it ends, tags at which the search stops)
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
}


class Node:
    """An element (tag set) or a text (data set)."""

    __slots__ = ("tag", "attrs", "kids", "up", "data", "seen", "below", "tags", "named", "plain")

    #: counts changes of any tree: what a node keeps of its descendants (below: elements, tags: elements by tag, named: those with attributes, plain: text) holds for one state
    changes = 0

    def __init__(self, tag=None, attrs=None, data=""):
        self.tag, self.attrs, self.kids, self.up, self.data = tag, attrs or {}, [], None, data
        self.seen = -1

    def add(self, kid: "Node") -> "Node":
        self.kids.append(kid)
        kid.up = self
        return kid

    def rename(self, tag: str) -> None:
        Node.changes += 1
        self.tag = tag

    def remove(self) -> None:
        if self.up:
            Node.changes += 1
            self.up.kids.remove(self)
            self.up = None

    def unwrap(self) -> None:
        if self.up:
            Node.changes += 1
            at = self.up.kids.index(self)
            self.up.kids[at : at + 1] = self.kids
            for k in self.kids:
                k.up = self.up
            self.up, self.kids = None, []

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def walk(self):
        """Descendants in document order."""
        stack = self.kids[::-1]
        while stack:
            n = stack.pop()
            yield n
            if n.kids:
                stack += n.kids[::-1]

    def _fresh(self) -> None:
        if self.seen != Node.changes:
            self.seen, self.below, self.tags, self.named, self.plain = Node.changes, None, None, None, None

    def elements(self) -> list["Node"]:
        """Elements below, in document order. The list is the node's own: copy it before changing the tree."""
        self._fresh()
        if self.below is None:
            out, stack = [], self.kids[::-1]
            while stack:
                n = stack.pop()
                if n.tag:
                    out.append(n)
                    if n.kids:
                        stack += n.kids[::-1]
            self.below = out
        return self.below

    def by_tag(self, tag: str) -> list["Node"]:
        self._fresh()
        if self.tags is None:
            found: dict[str, list] = {}
            for n in self.elements():
                found.setdefault(n.tag, []).append(n)
            self.tags = found
        return self.tags.get(tag, [])

    def with_attrs(self) -> list["Node"]:
        self._fresh()
        if self.named is None:
            self.named = [n for n in self.elements() if n.attrs]
        return self.named

    def above(self):
        n = self.up
        while n:
            yield n
            n = n.up

    def text(self) -> str:
        self._fresh()
        if self.plain is None:
            out, stack = [], self.kids[::-1]
            while stack:
                n = stack.pop()
                if n.tag:
                    if n.kids:
                        stack += n.kids[::-1]
                else:
                    out.append(n.data)
            self.plain = "".join(out)
        return self.plain

    def spaced(self) -> str:
        return " ".join(n.data for n in self.walk() if not n.tag).strip()

    def copy(self) -> "Node":
        new = Node(self.tag, dict(self.attrs), self.data)
        for k in self.kids:
            new.add(k.copy())
        return new

    def select(self, css: str) -> list["Node"]:
        return list(self._found(css))

    def first(self, css: str) -> "Node | None":
        return next(self._found(css), None)

    def _found(self, css: str):
        steps, tags, named = compiled(css)
        if len(tags) == 1 and len(steps) == 1:
            if not steps[0][1] and len(steps[0][2]) == 1:  # a tag alone
                yield from self.by_tag(tags[0])
                return
            near = self.by_tag(tags[0])
        elif named:
            near = self.with_attrs()
        elif tags and sum(len(self.by_tag(t)) for t in tags) == 0:
            return
        else:
            near = self.elements()
        for n in near:
            attrs = n.attrs
            for tag, need, chain in steps:
                if (not tag or n.tag == tag) and (not need or need in attrs) and matches(n, chain):
                    yield n
                    break


_STEP = re.compile(r"\s*(>|\s)?\s*((?:[\w*-]+|#[\w-]+|\.[\w-]+|\[[^\]]*\])+)")
_PART = re.compile(r"^([\w*-]+)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


@lru_cache(maxsize=2000)
def compiled(css: str) -> tuple:
    """For each selector of a list: the tag and one attribute that an element must have, and its steps from the right. Then the tags of all (none if one takes any tag), and whether all need an attribute."""
    out = []
    for part in re.split(r",(?![^\[]*\])", css):
        chain = []
        for joint, simple in _STEP.findall(part.strip()):
            tests = []
            for tag, ident, cls, attr, op, value in _PART.findall(simple):
                if tag:
                    tests.append(("tag", "", tag.lower()))
                elif ident:
                    tests.append(("id", "=", ident))
                elif cls:
                    tests.append(("class", "~=", cls))
                else:
                    tests.append((attr, op, value))
            chain.append((joint.strip(), tuple(tests)))
        last = chain[-1][1]
        tag = next((v for k, _, v in last if k == "tag" and v != "*"), "")
        out.append((tag, next((k for k, _, _ in last if k != "tag"), ""), tuple(reversed(chain))))
    tags = tuple(dict.fromkeys(t for t, _, _ in out))
    return tuple(out), () if "" in tags else tags, all(need for _, need, _ in out)


def _simple(n: Node, tests) -> bool:
    for name, op, value in tests:
        if name == "tag":
            if value != "*" and n.tag != value:
                return False
            continue
        own = n.attrs.get(name)
        if own is None:
            return False
        if not op:
            continue
        ok = own == value if op == "=" else value in own.split() if op == "~=" else bool(value) and (value in own if op == "*=" else own.startswith(value) if op == "^=" else own.endswith(value))
        if not ok:
            return False
    return True


def matches(n: Node, chain) -> bool:
    if not _simple(n, chain[0][1]):
        return False
    joint, rest = chain[0][0], chain[1:]
    if not rest:
        return True
    if joint == ">":
        return bool(n.up and n.up.tag and matches(n.up, rest))
    return any(a.tag and matches(a, rest) for a in n.above())


#: a tag with its attributes (quoted values may hold >), a comment, or another mark-up declaration
_MARKUP = re.compile(r"""<(?:(/?)([a-zA-Z][^\t\n\r\f />\x00]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z)|/>)""", re.S)
_OPEN_QUOTE = re.compile(r"<(/?)([a-zA-Z][^\t\n\r\f />\x00]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: elements whose content is text up to their end tag; in those of the second kind character references count
RAW, REFERENCES = frozenset("script style xmp iframe noembed noframes".split()), frozenset(("title", "textarea"))
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for t in RAW | REFERENCES}


class _Builder:
    """Cuts the source into tags and texts, and builds the tree from them."""

    def feed(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            while 0 <= lt < end - 1 and not (html[lt + 1].isalpha() or html[lt + 1] in "/!?"):
                lt = html.find("<", lt + 1)  # a plain character
            if lt < 0 or lt == end - 1:
                self.handle_data(self.plain(html[at:]))
                return
            if lt > at:
                self.handle_data(self.plain(html[at:lt]))
            m = _MARKUP.match(html, lt) or _OPEN_QUOTE.match(html, lt)
            if m is None:  # a tag that is cut off says nothing
                return
            at = m.end()
            if m.re is not _OPEN_QUOTE and m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.handle_endtag(tag)
                continue
            self.handle_starttag(tag, [(k.lower(), unescape(v) if "&" in v else v) for k, a, b, c in _ATTRIBUTE.findall(m[3]) for v in [a or b or c]] if m[3] else ())
            if tag in _ENDS:
                close = _ENDS[tag].search(html, at)
                if close.start() > at:
                    text = html[at : close.start()]
                    self.handle_data(self.plain(text) if tag in REFERENCES else text)
                at = close.end()
                if close.end() > close.start():
                    self.handle_endtag(tag)

    @staticmethod
    def plain(text: str) -> str:
        return unescape(text) if "&" in text else text

    def __init__(self):
        self.root = Node("#document")
        self.html = self.root.add(Node("html"))
        self.head = self.html.add(Node("head"))
        self.body: Node | None = None
        self.stack = [self.html, self.head]
        self.active: list[Node] = []

    def open_body(self) -> Node:
        if self.body is None:
            self.body = self.html.add(Node("body"))
            self.stack = [self.html, self.body]
        return self.body

    def in_head(self) -> bool:
        return self.body is None

    def insert(self, tag: str, attrs: dict) -> Node:
        n = Node(tag, attrs)
        top = self.stack[-1]
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr") and tag not in ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th", "script", "style", "template", "form", "input"):
            self.foster(n)
        else:
            top.add(n)
        if tag not in VOID:
            self.stack.append(n)
        return n

    def foster(self, n: Node) -> None:
        """What a table cannot hold goes before it."""
        table = next((x for x in reversed(self.stack) if x.tag == "table"), None)
        if table is None or table.up is None:
            self.stack[-1].add(n)
            return
        table.up.kids.insert(table.up.kids.index(table), n)
        n.up = table.up

    def close_to(self, k: int) -> None:
        del self.stack[max(k, 1) :]

    def close_p(self) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == "p":
                self.close_to(k)
                return
            if self.stack[k].tag in SCOPE or self.stack[k].tag == "button":
                return

    def reopen(self) -> None:
        """Formatting that a closed block left open goes on in the next one."""
        for i, n in enumerate(self.active):
            if n not in self.stack:
                self.active[i] = self.insert(n.tag, dict(n.attrs))

    def handle_starttag(self, tag, attrs):
        own: dict = {}
        for k, v in attrs:
            own.setdefault(k, v)
        if tag == "html":
            for k, v in own.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            return
        if tag == "body":
            for k, v in own.items():
                self.open_body().attrs.setdefault(k, v)
            return
        if self.in_head():
            if tag in HEAD_ONLY and (self.stack[-1] is self.head or tag in ("meta", "link")):
                n = self.head.add(Node(tag, own))
                if tag not in VOID:
                    self.stack.append(n)
                return
            self.open_body()
        if tag in CLOSES_P:
            self.close_p()
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            lowest = None
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in ends:
                    lowest = k
                    if tag in ("li", "dd", "dt", "option"):
                        break
                elif self.stack[k].tag in stops:
                    break
            if lowest is not None:
                self.close_to(lowest)
            if tag == "tr" and self.stack[-1].tag == "table":
                self.insert("tbody", {})
            elif tag in ("td", "th"):
                if self.stack[-1].tag == "table":
                    self.insert("tbody", {})
                if self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                    self.insert("tr", {})
        if tag == "a":
            old = next((n for n in self.active if n.tag == "a"), None)
            if old:
                self.end_formatting("a")
        if tag in FORMATTING:
            self.reopen()
            alike = [i for i, n in enumerate(self.active) if n.tag == tag and n.attrs == own]
            if len(alike) >= 3:  # as the standard has it, no more than three equal ones go on
                del self.active[alike[0]]
            self.active.append(self.insert(tag, own))
            return
        if tag not in CLOSES_P and tag not in IMPLIED and tag not in ("tbody", "thead", "tfoot", "caption", "col", "colgroup", "script", "style"):
            self.reopen()
        self.insert(tag, own)

    def end_formatting(self, tag: str) -> None:
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i].tag == tag:
                n = self.active.pop(i)
                if n in self.stack:
                    k = self.stack.index(n)
                    if any(x.tag in CLOSES_P or x.tag in SCOPE for x in self.stack[k + 1 :]):
                        del self.stack[k]  # a block is open inside: it goes on without the format
                    else:
                        self.close_to(k)
                return

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.in_head():
                self.open_body()
            return
        if self.in_head():
            if self.stack[-1].tag == tag and self.stack[-1] is not self.head:
                self.stack.pop()
            return
        if tag in FORMATTING:
            self.end_formatting(tag)
            return
        if tag == "p" and not any(n.tag == "p" for n in self.stack):
            self.reopen()
            self.insert("p", {})
        if tag == "br":
            self.insert("br", {})
            return
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k].tag
            if t == tag or (tag in HEADINGS and t in HEADINGS):
                if self.stack[k] is not self.body:
                    self.close_to(k)
                if tag in ("td", "th", "caption", "table"):
                    self.active = [n for n in self.active if n in self.stack]
                return
            if t in SCOPE and tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
                return

    def handle_data(self, data):
        top = self.stack[-1]
        if self.in_head():
            if top is not self.head:
                top.add(Node(data=data))
                return
            if not data.strip():
                return
            self.open_body()
            top = self.body
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr"):
            if data.strip():
                self.foster(Node(data=data))
            return
        if data.strip() and top.tag not in ("script", "style", "textarea", "title"):
            self.reopen()
        self.stack[-1].add(Node(data=data))


def parse(html: str) -> Node:
    """The document node; never fails."""
    b = _Builder()
    b.feed(html or "")
    b.open_body()
    return b.root
