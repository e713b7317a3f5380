"""The classic way of extraction, off by default: rules choose and prune sections, handlers rebuild elements one by one, and what no rule chose is recovered.

Also filters and fallbacks that are switched off in `page.extract` because they cost
accuracy there, for those who want them: link-dense sections, menu lines, a search by
length, the shorter metadata, the features of a trained quality score.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, OrderedDict

from . import metadata as M
from . import page as X
from . import values as V
from .dom import HEADINGS, Node, parse
from .rules import BLOCKS, CONTENT, DISCARD, DISCARD_BLOCKS, MAIN, Rule, attr, cls, contains, equals, ident, joined, low_cls, low_ident, starts

# ---------------------------------------------------------------- fixed values: rules
GROUPS = ("div", "section", "ol", "ul", "dl")
COMMENTS = (
    Rule(tags=GROUPS, tests=(contains(joined, "commentlist", "comment-list"), contains(cls, "comment-page", "comments-content", "post-comments"))),
    Rule(tags=GROUPS, tests=(starts(joined, "comments", "comment-"), starts(cls, "Comments"), contains(cls, "article-comments"))),
    Rule(tags=GROUPS, tests=(starts(ident, "comol", "disqus_thread", "dsq_comments"),)),
    Rule(tags=("div", "section"), tests=(starts(ident, "social"), contains(cls, "comment"))),
)
COMMENT_DEBRIS = (
    Rule(tags=("div", "section"), tests=(starts(ident, "respond"),)),
    Rule(tags=("cite", "quote")),
    Rule(tests=(contains(cls, "comments-title", "nocomments", "-reply-", "message", "signin"), starts(joined, "reply-"), contains(joined, "akismet"), contains(attr("style"), "display:none"))),
)
COMMENT_SECTIONS = (Rule(tags=GROUPS, tests=(starts(low_ident, "comment"), starts(low_cls, "comment"), contains(cls, "article-comments", "post-comments"), starts(ident, "comol", "disqus_thread", "dsq-comments"))),)
PRECISION = (
    Rule(tags=("header",)),
    Rule(tags=BLOCKS, tests=(contains(joined, "bottom", "link"), contains(attr("style"), "border"))),
    Rule(tests=(contains(joined, "fs-headline"), contains(cls, "read-more", "bottom", "generic", "jumbotron"))),
)
TEASERS = (
    Rule(tags=BLOCKS, tests=(contains(low_ident, "teaser"), contains(low_cls, "teaser"))),
    Rule(tests=(contains(cls, "teaser", "excerpt", "summary", "promoted", "sponsored", "paid"), contains(joined, "context", "cta", "promo"))),
)
CAPTIONS = (Rule(tags=BLOCKS, tests=(contains(ident, "caption"), contains(cls, "caption"))),)
SECTIONS = (*CONTENT, MAIN, Rule(tags=("main",)), Rule(tests=(equals(attr("role"), "main"),)))
DISCARDED = (*DISCARD, DISCARD_BLOCKS)


# ---------------------------------------------------------------- pruning
def links_of(n: Node, o: X.Options) -> tuple[bool, bool]:
    """Whether n has links with text, and whether it is mostly links."""
    return any(a.text().strip() for a in n.select("a")), X.link_dense(n, o)


def prune(tree: Node, rules, backup: bool = False) -> Node:
    """A copy of tree without what the rules match; text behind a match stays. With backup the whole tree if hardly a seventh of its text is left."""
    new = tree.copy()
    for rule in rules:
        for n in reversed(list(rule.within(new))):
            n.remove()
    return tree.copy() if backup and 7 * len(new.text()) <= len(tree.text()) else new


def drop_link_dense(tree: Node, o: X.Options, tags: tuple[str, ...], backtracking: bool = False) -> None:
    """Remove elements of these tags that are mostly links; with backtracking also short ones that have links and several children."""
    most, least = (200, 1) if o.favor_precision else (100, 3)
    gone = []
    for n in tree.select(", ".join(tags)):
        linked, dense = links_of(n, o)
        if dense or (backtracking and linked and 0 < len(n.text().strip()) < most and sum(bool(k.tag) for k in n.kids) >= least):
            gone.append(n)
    for n in reversed(gone):
        n.remove()


def pruned(tree: Node, o: X.Options) -> Node:
    """A section without boilerplate, teasers (unless recall matters), captions (unless images do) and link lists."""
    tree = prune(tree, DISCARDED, backup=True)
    rules = [*(() if o.favor_recall else TEASERS), *(() if o.include_images else CAPTIONS), *(PRECISION if o.favor_precision else ())]
    tree = prune(tree, rules, backup=not o.favor_precision)
    for tags in (("div",), ("ul", "ol", "dl"), ("p",)):
        drop_link_dense(tree, o, tags, backtracking=tags[0] == "div")
    if o.include_tables:
        for t in tree.select("table"):
            if X.table_link_dense(t):
                t.remove()
    return tree


class Repeats:
    """Texts seen lately; a long one counts as repeated from its fourth time on."""

    def __init__(self, size: int = 4096, most: int = 2, least: int = 100):
        self.size, self.most, self.least, self.count = size, most, least, OrderedDict()

    def repeated(self, text: str) -> bool:
        text = text.strip()
        if len(text) <= self.least:
            return False
        seen = self.count.pop(text, 0)
        self.count[text] = seen + 1
        if len(self.count) > self.size:
            self.count.popitem(last=False)
        return seen > self.most


# ---------------------------------------------------------------- handlers
INLINE = frozenset("a abbr b big cite code em font i mark q s small span strong sub sup tt u".split())
KEPT = frozenset("b strong em i code sub sup u".split())


class State:
    """What is done, which tags may stand in the result, and texts seen."""

    def __init__(self, o: X.Options):
        self.done: set[int] = set()
        self.tags = {"p", "blockquote", "pre", "code", "ul", "ol", "li", "dl", "dt", "dd", *HEADINGS, *KEPT, "br"} | ({"table"} if o.include_tables else set()) | ({"img"} if o.include_images else set()) | ({"a"} if o.include_links else set()) | ({"div"} if o.favor_recall else set())
        self.repeats = Repeats(o.dedup_cache_size)


def useless(text: str) -> bool:
    """Neither letters nor digits, or a share button's text."""
    return not any(c.isalnum() for c in text) or any(V.is_share(line) for line in text.splitlines() if line.strip())


def inline(n: Node, into: Node, o: X.Options) -> Node:
    """Texts and inline mark-up of n, without attributes."""
    for k in n.kids:
        if not k.tag:
            into.add(Node(data=k.data))
        elif k.tag == "br":
            into.add(Node("br"))
        elif k.tag in KEPT:
            inline(k, into.add(Node(k.tag)), o)
        elif k.tag == "a" and o.include_links:
            inline(k, into.add(Node("a", {"href": k.get("href")} if k.get("href") else {})), o)
        elif k.tag in INLINE or k.tag in ("p", "div", *HEADINGS):
            inline(k, into, o)
    return into


def handled(n: Node, state: State, o: X.Options) -> Node | None:
    """The element that n becomes in the result, or None."""
    state.done |= {id(n), *map(id, n.elements())}
    if n.tag == "img":
        return Node("img", {k: n.get(k) for k in ("src", "alt") if n.get(k)}) if "img" in state.tags and (n.get("src") or n.get("data-src")) else None
    if n.tag == "br":
        rest = X.tail(n)
        return None if useless(rest) else _of("p", Node(data=rest.strip()))
    if useless(n.spaced()) or (o.deduplicate and state.repeats.repeated(n.spaced())):
        return None
    if n.tag == "table":
        return X.content_tree(_of("div", n.copy()), o, False).kids[0] if "table" in state.tags else None
    if n.tag in ("ul", "ol", "dl"):
        out = Node(n.tag)
        for k in n.kids:
            if k.tag in ("li", "dt", "dd") and not useless(k.spaced()):
                item = out.add(inline(k, Node(k.tag), o))
                for sub in (x for x in k.kids if x.tag in ("ul", "ol", "dl")):
                    if got := handled(sub, state, o):
                        item.add(got)
        return out if out.kids else None
    if n.tag in ("pre", "code"):
        return _of(n.tag, Node(data=n.text().strip("\n")))
    if n.tag in ("blockquote", "q"):
        return inline(n, Node("blockquote"), o)
    if n.tag in HEADINGS or n.tag == "p":
        return inline(n, Node(n.tag), o)
    return inline(n, Node("p"), o) if n.tag in INLINE or n.tag == "div" else None


def _of(tag: str, kid: Node) -> Node:
    out = Node(tag)
    out.add(kid)
    return out


def rebuilt(tree: Node, state: State, o: X.Options, tags) -> list[Node]:
    """The results of the outermost elements of these tags below tree, in order; those already done are left out."""
    out = []
    for n in tree.elements():
        if id(n) not in state.done and (n.tag in tags or (n.tag in ("div", "section", "article") and n.tag in state.tags and not any(k.tag and k.tag not in INLINE for k in n.kids) and n.text().strip())):
            got = handled(n, state, o)
            if got:
                out.append(got)
    return out


def extract(html: str, o: X.Options | None = None) -> dict:
    """content_text, content_html, comments_text, used_recovery: the classic pipeline over a page."""
    o = o or X.Options()
    doc = parse(html or "")
    body = X.body_of(doc)
    comments = None
    if o.include_comments:
        comments = comments_text(doc, o)
    else:
        for rule in COMMENT_SECTIONS:
            for n in reversed(list(rule.within(body))):
                n.remove()
    for n in doc.select("script, style, nav, aside, footer, form, iframe, noscript, svg, button"):
        n.remove()
    state, result = State(o), Node("body")
    whole = {"p", "blockquote", "pre", "code", "ul", "ol", "dl", "table", "img", *HEADINGS}
    for rule in SECTIONS:
        section = next(rule.within(body), None)
        if section is None:
            continue
        parts = rebuilt(pruned(section, o), state, o, whole - ({"table"} - state.tags))
        if sum(len(n.spaced()) for n in parts) >= o.min_extracted_size:
            for n in parts:
                result.add(n)
            break
    recovered = not result.kids
    if recovered:  # what no rule chose
        tags = {"blockquote", "pre", "q", "code", "p", "table"} | ({"div", "br", "ul", "ol", "dl"} if o.favor_recall else set())
        for n in rebuilt(pruned(body, o), State(o), o, tags):
            result.add(n)
    for n in reversed(result.elements()):
        if n.tag not in ("br", "img", "td", "th") and not n.spaced():
            n.remove()
    text = "\n".join(t for n in result.kids if (t := X.table_text(n) if n.tag == "table" else V.clean(n.spaced()) if n.tag not in ("pre", "code") else n.text()))
    return {"content_text": text, "content_html": X.markup(result), "comments_text": comments, "used_recovery": recovered}


def comments_text(doc: Node, o: X.Options) -> str | None:
    """Texts of the first comment section that has any; the section is taken out of doc."""
    body = X.body_of(doc)
    for rule in COMMENTS:
        section = next(rule.within(body), None)
        if section is None:
            continue
        kept = prune(section, COMMENT_DEBRIS)
        parts = [V.clean(n.spaced()) for n in kept.select("p, blockquote, li") if not useless(n.spaced())]
        if parts:
            section.remove()
            return " ".join(dict.fromkeys(parts))
    return None


# ---------------------------------------------------------------- filters that are off
def grade(value: float, steps: tuple[float, float]) -> int:
    """0 to 2 by two ascending limits."""
    return bisect_right(steps, value)


def strip_link_sections(html: str) -> str:
    """html without sections that look like menus: of eight points for dense, short, close and many links, five or more. Unchanged if that would take more than half of its text."""
    body = X.body_of(parse(html))
    before, changed = len(body.text().strip()), False
    for tag in ("div", "section", "ul", "nav", "aside", "footer"):
        for n in body.select(tag):
            links, length = n.select("a"), V.size(n.text().strip())
            if len(links) < 3 or length < 30 or not n.up:
                continue
            linked = sum(V.size(a.text().strip()) for a in links)
            mean, gap = linked / len(links), max(length - linked, 0) / max(len(links) - 1, 1)
            density = linked / length
            points = (2 if density > 0.6 else 1 if density > 0.4 else 0) + 2 - grade(mean, (15, 30)) + 2 - grade(gap, (10, 30)) + grade(len(links), (5, 10))
            if points >= 5:
                n.remove()
                changed = True
    return X.markup(X.content_tree(body, X.Options(include_links=True), False)) if changed and 2 * len(body.text().strip()) >= before else html


BY_LENGTH = ("article", "main", "[role='main']", "#content", ".content", "#main", ".main", "#main-content", ".main-content", "article[role='article']")


def longer_text(doc: Node, o: X.Options, length: int) -> tuple[str, str] | None:
    """Text and HTML of the longest element by the usual selectors, for pages of which under 200 characters came out."""
    best: tuple[str, str] | None = None
    most = length
    for css in BY_LENGTH if length < 200 else ():
        found = [n for n in doc.select(css) if n.tag not in ("nav", "header", "footer", "aside", "script", "style") and V.size(n.text().strip()) >= 50]
        if not found:
            continue
        n = max(found, key=lambda x: V.size(x.text().strip()))
        text = X.render_text(n, o, False)
        if V.size(text) > most and V.size(text) >= 200:
            best, most = (text, X.render_html(n, o, False)), V.size(text)
            if most >= 2 * length:
                break
    return best


MENU_STARTS = ("< back", "<back", "back |", "| forward", "forward >", "home |", "| home", "| about", "| contact", "| links", "skip to content", "skip to main", "jump to navigation")


def strip_menu_line(text: str) -> str:
    """text without a first line (or sentence) that is a menu."""
    if text.lower().startswith(MENU_STARTS):
        line, _, rest = text.partition("\n")
        text = rest.lstrip() if "\n" in text else text.partition(". ")[2] if ". " in text else text
    line, _, rest = text.partition("\n")
    return rest.lstrip() if "\n" in text and (line.count("|") >= 2 or (line.count(">") >= 2 and line.count("<") >= 2)) else text


# ---------------------------------------------------------------- metadata
GRAPH = {"og:title": "title", "og:description": "description", "og:site_name": "sitename", "og:url": "url", "og:image": "image", "og:type": "og_type", "og:locale": "language"}


def open_graph(doc: Node) -> dict[str, str]:
    """Open Graph properties alone, the first of each."""
    out: dict[str, str] = {}
    for m in doc.select("meta[property^='og:']"):
        field, value = GRAPH.get(m.get("property")), m.get("content")
        if field and value:
            out.setdefault(field, value.split("_")[0].lower() if field == "language" else value)
    return out


def light_metadata(doc: Node, url: str | None) -> dict:
    """URL and host as given, the rest of meta tags, the title of the document without one."""
    out: dict = {"url": url, "hostname": V.host(url)}
    M.from_meta(doc, lambda k, v: out.setdefault(k, v) if v else None)
    if not out.get("title"):
        out["title"] = M.title_of(doc) or M.first_h1(doc)
    return out


# ---------------------------------------------------------------- features of a trained quality score
QUALITY_FEATURES = ("heuristic", "bytes", "words", "distinct_words", "word_length", "sentences", "sentence_length", "distinct_sentences", "paragraphs", "paragraph_length", "links", "links_per_word", "notices", *(f"is_{k}" for k in ("article", "collection", "documentation", "forum", "listing", "product", "service")), "of_expected", "html_bytes", "share_of_html", "of_description", "scripts", "has_data", "top_pair")
EXPECTED = {"article": 10228, "forum": 6698, "product": 3052, "collection": 4423, "listing": 6275, "documentation": 8000, "service": 5845}
NOTICES = ("cookie", "consent", "subscribe", "newsletter", "sign up", "skip to", "copyright", "privacy", "terms", "accept")


def quality_features(text: str, html: str | None, source: str, kind: str) -> list[float]:
    """The 27 numbers of QUALITY_FEATURES for an extraction of page source; there are no weights, train your own on them."""
    doc, low = parse(source), text.lower()
    words, n, size = low.split(), V.size(text), V.size(source)
    mean = lambda xs: sum(map(V.size, xs)) / len(xs) if xs else 0.0
    sentences = [s for x in re.split(r"[.!?\n]", text) if V.size(s := x.strip()) > 10]
    paragraphs = [s for x in text.split("\n\n") if V.size(s := x.strip()) > 20]
    links = text.count("http://") + text.count("https://")
    about = open_graph(doc).get("description", "")
    own = set(about.lower().split())
    pairs = Counter(zip(words, words[1:], strict=False)) if len(words) > 50 else {}
    f = [V.quality(text, html, size, kind), n, len(words), len(set(words)) / max(len(words), 1), mean(words), len(sentences), mean(sentences), len(set(sentences)) / max(len(sentences), 1), len(paragraphs), mean(paragraphs), links, links / max(len(words), 1)]
    f.append(sum(w in low[:500] for w in NOTICES))
    f += [float(kind == k) for k in ("article", "collection", "documentation", "forum", "listing", "product", "service")]
    f += [n / EXPECTED[kind], size, n / max(size, 1), len(own & set(words[:200])) / len(own) if V.size(about) > 20 and own else -1.0]
    f += [len(doc.select("script")), float(bool(doc.select("script[type='application/ld+json']"))), max(pairs.values()) / (len(words) - 1) if pairs else 0.0]
    return [float(x) for x in f]
