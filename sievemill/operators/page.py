"""Extraction of one page: cleaning, choice of the content node, rendering and the fallbacks. Pure functions of the page and the options."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields
from functools import cache

from . import metadata as M
from . import profiles as P
from . import rules as R
from . import values as V
from .dom import HEADINGS, Node, parse


@dataclass(frozen=True)
class Options:
    """All settings. Those after `page_type` are accepted for compatibility and change nothing, as in the original behaviour."""

    include_comments: bool = False
    include_tables: bool = True
    include_images: bool = False
    include_links: bool = False
    favor_precision: bool = False
    favor_recall: bool = False
    target_language: str | None = None
    url: str | None = None
    author_blacklist: tuple[str, ...] = ()
    min_extracted_size: int = 200
    min_extracted_len: int = 200
    max_extracted_len: int = 1_000_000
    min_output_size: int = 50
    min_output_comm_size: int = 10
    min_word_length: int = 2
    use_fallback_extraction: bool = True
    output_markdown: bool = False
    page_type: str | None = None
    deduplicate: bool = False
    min_score: int = 1000
    max_duplicate_ratio: float = 0.5
    max_link_density: float = 0.5
    min_paragraph_cluster: int = 3
    include_formatting: bool = True
    only_with_metadata: bool = False
    max_tree_depth: int = 500
    dedup_cache_size: int = 4096
    include_title_in_content: bool = False

    def with_(self, **changes) -> "Options":
        return Options(**({f.name: getattr(self, f.name) for f in fields(self)} | changes))


# ---------------------------------------------------------------- cleaning
def inside(n: Node, tags) -> bool:
    return any(a.tag in tags for a in n.above())


def clean(doc: Node, body: Node, o: Options, profile: P.Profile) -> None:
    if profile.remove:
        for n in doc.select(profile.remove):
            n.remove()
    for n in doc.select("figure"):
        if n.first("blockquote") or (o.include_tables and n.first("table")):
            n.rename("div")
    for n in doc.select("noscript"):
        t = n.text()
        if V.size(t) > 500 and not re.search("(?i)cookie|consent|gdpr", t):
            n.unwrap()
    for n in doc.select("footer"):
        if not inside(n, ("article", "main")):
            n.remove()
    out = (P.CLEAN - {"footer"}) - set(profile.keep_tags)
    strip = P.STRIP
    if o.include_images:
        out, strip = out - {"figure", "picture", "source"}, strip - {"img"}
    if not o.include_tables:
        out = out | {"table", "td", "th", "tr"}
    for n in doc.elements():
        if n.tag in out and n.up:
            n.remove()
    for n in doc.select(P.OVERLAYS):
        n.remove()
    for n in doc.elements():
        if n.tag in strip:
            n.unwrap()
    if V.size(body.text()) < 1_000_000:
        for n in reversed(doc.elements()):
            if n.tag in P.EMPTY and not any(k.tag or k.data.strip() for k in n.kids) and not tail(n).strip():
                n.remove()


def tail(n: Node) -> str:
    """Text between an element and its next sibling element."""
    if not n.up:
        return ""
    out, kids = [], n.up.kids
    for k in kids[kids.index(n) + 1 :]:
        if k.tag:
            break
        out.append(k.data)
    return "".join(out)


# ---------------------------------------------------------------- link density
def link_info(links: list[Node]) -> tuple[int, int, int]:
    lengths = [n for a in links if (n := len(a.text().strip()))]
    return sum(lengths), sum(n < 10 for n in lengths), len(lengths)


def has_next(n: Node) -> bool:
    return bool(n.up) and any(k.tag for k in n.up.kids[n.up.kids.index(n) + 1 :])


def link_dense(n: Node, o: Options) -> bool:
    links = n.select("a")
    if not links:
        return False
    length = len(n.text().strip())
    if len(links) == 1:
        own = len(links[0].text().strip())
        if own > (10 if o.favor_precision else 100) and own > 0.9 * length:
            return True
    limit = (30 if has_next(n) else 60) if n.tag == "p" else 100 if has_next(n) else 300
    total, short, used = link_info(links)
    if length < limit and (not used or total > 0.8 * length or (used > 1 and short / used > 0.8)):
        return True
    return len(links) >= 5 and n.tag != "p" and used > 0 and not n.first("p") and total / max(length, 1) > 0.5 and short / used > 0.5


def table_link_dense(n: Node) -> bool:
    links, length = n.select("a"), len(n.text().strip())
    if not links or length < 200:
        return False
    total, _, used = link_info(links)
    return not used or total > (0.8 if length < 1000 else 0.5) * length


# ---------------------------------------------------------------- rendering
def span_of(n: Node, name: str) -> int:
    v = n.get(name).strip()
    return max(int(v), 1) if v.isascii() and v.isdigit() and len(v) < 10 else 1


def is_layout(table: Node) -> bool:
    return table.get("role").lower() == "presentation" or len(table.select("tr")) <= 1 or len(table.select("td, th")) <= 1


def table_text(table: Node, most_cells: int = 20_000, most_bytes: int = 200_000) -> str:
    rows, carried, cells, length = [], {}, 0, 0
    for tr in table.select("tr"):
        if cells >= most_cells or length >= most_bytes:
            break
        row: list[str] = []

        def carry(row=row):
            while len(row) in carried:
                left, text = carried.pop(len(row))
                if left > 1:
                    later[len(row)] = (left - 1, text)
                row.append(text)

        later: dict = {}
        for cell in tr.select("td, th"):
            carry()
            text, down = V.clean(cell.text()), span_of(cell, "rowspan")
            for _ in range(min(span_of(cell, "colspan"), most_cells - cells)):
                cells += 1
                if down > 1:
                    later[len(row)] = (down - 1, text)
                row.append(text)
        carry()
        carried = {**carried, **later}
        if any(c.strip() for c in row):
            rows.append(" | ".join(row))
            length += len(rows[-1]) + 1
    return "\n".join(rows)


def named_out(n: Node, names: bool, comments: bool) -> bool:
    for v in (n.get("class"), n.get("id")):
        if v and (R.always_out(v) or (names and R.boilerplate(v, comments))):
            return True
    return "breadcrumblist" in n.get("itemtype").lower()


HEADLINE = ("entry-title", "post-title", "article-title", "story-title", "pg-headline", "headline")


def render_text(root: Node, o: Options, names: bool = True, title: str | None = None, comments: bool = False) -> str:
    out: list[str] = []

    def skip(n: Node, within: bool) -> bool:
        if n.tag in P.NEVER or (n.tag in ("header", "footer") and not within) or named_out(n, names, comments) or (n.tag == "footer" and R.boilerplate(n.get("class"), comments)):
            return True
        if n.tag in ("div", "ul", "ol") and link_dense(n, o):
            return True
        if n.tag in HEADINGS:
            t = V.clean(n.spaced())
            low = n.get("class").lower()
            if V.is_share(t) or any(w in low for w in HEADLINE) or n.get("itemprop").lower() == "headline" or (n.tag == "h1" and title and V.titles_match(t, title)):
                return True
        limit = 50 if n.tag == "p" else 80 if n.tag == "div" else 0
        return bool(limit) and V.size(t := n.spaced()) < limit and V.is_share(t)

    # the root's own ancestors count for headers and footers only if the root is the article or main itself
    stack = [(k, root.tag in ("article", "main")) for k in reversed(root.kids)]
    while stack:
        n, within = stack.pop()
        if not n.tag:
            if not (n.up and n.up.tag in ("script", "style", "noscript")):
                out += (n.data, " ")
            continue
        if n.tag == "table":
            if named_out(n, names, comments) or table_link_dense(n) or not o.include_tables:
                continue
            if not is_layout(n):
                if t := table_text(n):
                    out += ("\n\n", t, "\n\n")
                continue
        if skip(n, within):
            continue
        if n.tag in ("p", "div", "section", "article") or n.tag in HEADINGS:
            out.append("\n\n")
        elif n.tag in ("br", "li"):
            out.append("\n")
        within = within or n.tag in ("article", "main")
        stack += [(k, within) for k in reversed(n.kids)]
    return V.normalize("".join(out))


def content_tree(root: Node, o: Options, names: bool = True, comments: bool = False) -> Node:
    """What the content keeps of its mark-up, under a body of its own."""
    body = Node("body")

    def walk(n: Node, into: Node, within: bool, layout: bool) -> None:
        for k in n.kids:
            if not k.tag:
                into.kids.append(Node(data=k.data))
                continue
            if (k.tag in ("header", "footer") and not within) or k.tag in P.NEVER or named_out(k, names, comments):
                continue
            now = within or k.tag in ("article", "main")
            if layout and k.tag in P.TABLE_TAGS:
                walk(k, into, now, True)
            elif k.tag == "table" and (not o.include_tables or is_layout(k)):
                walk(k, into, now, True)
            elif k.tag in P.HTML_TAGS:
                kept = (["href"] if k.tag == "a" and o.include_links else []) + (["class"] if k.tag == "code" else []) + (["colspan", "rowspan"] if k.tag in ("td", "th") else [])
                walk(k, into.add(Node(k.tag, {a: k.attrs[a] for a in kept if k.attrs.get(a) is not None})), now, layout)
            elif k.tag == "br":
                into.add(Node("br"))
            else:
                walk(k, into, now, layout)

    walk(root, body, root.tag in ("article", "main"), False)
    return body


def markup(n: Node) -> str:
    """The HTML inside n."""
    out: list[str] = []

    def walk(n: Node) -> None:
        for k in n.kids:
            if not k.tag:
                out.append(V.escape(k.data))
            elif k.tag == "br":
                out.append("<br>")
            else:
                out.append(f"<{k.tag}" + "".join(f' {a}="{V.escape(v)}"' for a, v in k.attrs.items()) + ">")
                walk(k)
                out.append(f"</{k.tag}>")

    walk(n)
    return "".join(out)


def render_html(root: Node, o: Options, names: bool = True, comments: bool = False) -> str:
    return markup(content_tree(root, o, names, comments))


def body_of(doc: Node) -> Node:
    return doc.by_tag("body")[0]


def render_markdown(body: Node, o: Options) -> str:
    esc = lambda s: re.sub(r"([\\*_\[\]<>])", r"\\\1", s)

    def inline(n: Node, raw: bool = False) -> str:
        out = []
        for k in n.kids:
            if not k.tag:
                out.append(k.data if raw else esc(re.sub(r"\s+", " ", k.data)))
            elif k.tag == "br":
                out.append("  \n")
            elif k.tag in ("strong", "b", "em", "i"):
                t, mark = inline(k), "**" if k.tag in ("strong", "b") else "*"
                out.append(f"{mark}{t.strip()}{mark}" if t.strip() else t)
            elif k.tag == "code":
                out.append(f"`{k.text()}`")
            elif k.tag == "a" and o.include_links and k.get("href"):
                out.append(f"[{inline(k)}]({k.get('href')})")
            elif k.tag == "img" and o.include_images:
                out.append(f"![{k.get('alt')}]({k.get('src')})")
            else:
                out.append(inline(k, raw))
        return "".join(out)

    def items(n: Node, depth: int) -> list[str]:
        out, number = [], 1
        for li in (k for k in n.kids if k.tag == "li"):
            text = inline(Node.copy(li) if not li.first("ul, ol") else without(li)).strip()
            out.append("  " * depth + (f"{number}. " if n.tag == "ol" else "- ") + text)
            number += 1
            for sub in (k for k in li.kids if k.tag in ("ul", "ol")):
                out += items(sub, depth + 1)
        return out

    def without(li: Node) -> Node:
        li = li.copy()
        for x in li.select("ul, ol"):
            x.remove()
        return li

    def blocks(n: Node) -> list[str]:
        out: list[str] = []
        flow = Node("span")

        def flush():
            t = inline(flow).strip()
            flow.kids = []
            if t:
                out.append(t)

        for k in list(n.kids):
            if not k.tag or k.tag in ("a", "b", "i", "em", "strong", "code", "br", "span", "img"):
                flow.kids.append(k)
                continue
            flush()
            if k.tag in HEADINGS:
                if t := inline(k).strip():
                    out.append("#" * int(k.tag[1]) + " " + t)
            elif k.tag == "pre":
                code = k.first("code")
                lang = (code.get("class") if code else "").removeprefix("language-").split(" ")[0]
                out.append(f"```{lang}\n{k.text().strip(chr(10))}\n```")
            elif k.tag == "blockquote":
                out.append("\n".join("> " + line if line else ">" for line in "\n\n".join(blocks(k)).split("\n")))
            elif k.tag in ("ul", "ol"):
                if t := "\n".join(items(k, 0)):
                    out.append(t)
            elif k.tag == "table":
                if t := markdown_table(k):
                    out.append(t)
            elif k.tag == "p":
                if t := inline(k).strip():
                    out.append(t)
            else:
                out.extend(blocks(k))
        flush()
        return out

    return "\n\n".join(blocks(body))


def markdown_table(table: Node) -> str:
    """A pipe table; the first row is the header, align attributes give the separators."""
    rows = [[(V.clean(c.text()).replace("|", r"\|"), c.get("align").lower()) for c in tr.select("td, th")] for tr in table.select("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    columns = max(map(len, rows))
    width = [max(3, *(len(r[i][0]) for r in rows if i < len(r))) for i in range(columns)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"
    rule = {"left": lambda w: ":" + "-" * (w - 1), "right": lambda w: "-" * (w - 1) + ":", "center": lambda w: ":" + "-" * (w - 2) + ":"}
    align = [rows[0][i][1] if i < len(rows[0]) else "" for i in range(columns)]
    body = [line([r[i][0] if i < len(r) else "" for i in range(columns)]) for r in rows]
    return "\n".join([body[0], "| " + " | ".join(rule.get(a, lambda w: "-" * w)(w) for a, w in zip(align, width, strict=True)) + " |", *body[1:]])


# ---------------------------------------------------------------- the content node
def language_ok(n: Node, o: Options, page: str | None) -> bool:
    if not o.target_language:
        return True
    own = V.language(n.get("lang")) if n.get("lang") else page
    return not own or own == V.language(o.target_language)


def find_content(body: Node) -> Node | None:
    bad = {id(n) for tag in ("header", "nav", "aside", "footer") for n in body.by_tag(tag)} | {id(n) for n in body.with_attrs() if n.get("class") and R.around_boilerplate(n.get("class"))}
    within = lambda n: any(id(a) in bad for a in n.above() if a is not body)

    def nested(n: Node) -> bool:
        articles = n.select("article")
        inner = articles if len(articles) > 1 else n.select(P.NESTED)
        return any(V.size(x.text().strip()) >= 1000 for x in inner)

    for k in range(6):
        for n in R.content_elements(k, body):
            if within(n):
                continue
            deep = nested(n)
            if deep and n.tag in ("div", "section") and n.first(P.BOILER_CHILD):
                continue
            if deep and n.tag == "article" and not n.get("class") and n.first("article[class*='content_main'], article[class*='content-main'], article[class*='article-body'], article[class*='article-content'], article[class*='entry-content'], article[class*='post-content']"):
                continue
            length = V.size(n.text().strip())
            if length >= 1000:
                return n
            if n.up and n.up.tag and not within(n.up):
                wide = V.size(n.up.text().strip())
                if wide > 2 * length and wide >= 1000:
                    return n.up
    return None


def node_score(n: Node) -> tuple[int, int]:
    """Score and bytes of clean text."""
    text = V.clean(n.text())
    length = V.size(text)
    most = min(length, 8000)
    ps = n.select("p")
    score = most + 200 * len(ps) + 100 * len(n.select("h1, h2, h3, h4, h5, h6")) + 300 * sum(V.size(V.clean(p.text())) >= 100 for p in ps) + 50 * min(V.sentences(text), most // 50) + 10 * sum(1 for _ in n.above()) + R.name_score(n)
    density = sum(V.size(V.clean(a.text())) for a in n.select("a")) / length if length else 0.0
    return int(score * (1 - density) if density > 0.5 else score * (1 - density / 2) if density > 0.25 else score), length


def heuristic(body: Node, o: Options, page: str | None) -> Node | None:
    whole = V.size(V.clean(body.text()))
    best, top, size = None, 0, 0
    for tag in ("div", "section", "article", "main"):
        for n in body.select(tag):
            if language_ok(n, o, page):
                score, length = node_score(n)
                if score > top:
                    best, top, size = n, score, length
    if best is None and 0 < whole <= 500 and not o.target_language:
        return body
    least = 5000 if o.favor_precision else 500 if o.favor_recall else 1000
    return best if best and top >= least and size >= 0.3 * whole else None


def together(found: list[Node]) -> Node:
    """All of found as one content node: what stands in them, in document order, once where they are nested."""
    own = {id(n) for n in found}
    outer = [n for n in found if not any(id(a) in own for a in n.above())]
    if len(outer) == 1:
        return outer[0]
    group = Node(outer[0].tag)
    for n in outer:
        group.kids += [*n.kids, Node(data="\n\n")]
    return group


def content_node(doc: Node, body: Node, o: Options, profile: P.Profile, page: str | None) -> Node | None:
    for css in profile.content:
        found = doc.select(css)
        if sum(V.size(n.text().strip()) for n in found) > 100:
            return together(found)
    n = find_content(body)
    if n and language_ok(n, o, page):
        return n
    for css in (P.ARTICLES, P.MAINS):
        found = next((n for n in doc.select(css) if language_ok(n, o, page)), None)
        if found:
            return found
    return heuristic(body, o, page)


def bottom_up(body: Node) -> Node | None:
    """Paragraph scores handed to the parent in full and to the grandparent by half; the best container by share of link text."""
    scores: dict[int, list] = {}
    for p in body.select("p, pre, td, blockquote"):
        t = V.clean(p.text())
        if V.size(t) < 25:
            continue
        own = 1 + t.count(",") + min(V.size(t) / 100, 3)
        for a, share in zip(p.above(), (1.0, 0.5), strict=False):
            if a.tag and a.tag not in ("html", "#document"):
                scores.setdefault(id(a), [R.name_score(a), a])[0] += own * share
    best = None
    for s, n in scores.values():
        length = V.size(V.clean(n.text()))
        if length >= 100:
            s *= 1 - min(sum(V.size(V.clean(a.text())) for a in n.select("a")) / length, 1)
            if best is None or s > best[0]:
                best = (s, n)
    return best[1] if best else None


def split_bodies(node: Node, text: str, o: Options, title, relaxed: bool, comments: bool) -> list[Node]:
    """Content in several bodies of one article, if together they fit better."""
    article = node if node.tag == "article" else next((a for a in node.above() if a.tag == "article"), None)
    if article is None or V.size(text) >= 5000:
        return []
    for name in P.SPLIT_BODIES:
        if name == "entry-content" and not relaxed:
            continue
        found: list[Node] = []
        for n in article.elements():
            if name in n.get("class").lower() and not any(a in found for a in n.above()):
                found.append(n)
        found = [n for n in found if "truncat" not in n.get("class").lower() and (n.first("p") or V.size(n.text().strip()) >= 200)]
        if len(found) >= 2:
            merged = "\n\n".join(render_text(n, o, not relaxed, title, comments) for n in found)
            if 1.2 * V.size(text) < V.size(merged) <= min(4 * V.size(text), 20_000):
                return found
    return []


def main_content(doc: Node, body: Node, o: Options, profile: P.Profile, title: str | None, page: str | None) -> tuple[str, str, Node | None] | None:
    """Text, HTML and (unless it is of several bodies) the tree of the content."""
    comments = profile.comments_are_content
    show = lambda n, names=True: render_text(n, o, names, title, comments)
    node = content_node(doc, body, o, profile, page)
    if node is None:
        node = body
    text = show(node)
    if len(text) < 1000:
        at = node
        for _ in range(2):
            at = at.up
            if at is None or at.tag in ("body", "html", "#document"):
                break
            wide = show(at)
            if len(wide) > 2 * len(text):
                node, text = at, wide
                break
        if len(text) < 1000 and node is not body and (n := bottom_up(body)) is not None and n is not node:
            wide = show(n)
            if len(wide) > 2 * len(text) and len(wide) > 500:
                node, text = n, wide
    relaxed = False
    if not text and node is not body:
        if wide := show(body):
            node, text = body, wide
    if not text:
        text, relaxed = show(node, False), True
    if not text:
        return None
    parts = split_bodies(node, text, o, title, relaxed, comments)
    if parts:
        return "\n\n".join(show(n, not relaxed) for n in parts), "".join(render_html(n, o, not relaxed, comments) for n in parts), None
    tree = content_tree(node, o, not relaxed, comments)
    return text, markup(tree), tree


# ---------------------------------------------------------------- fallbacks
def article_body(blocks) -> str | None:
    todo = list(blocks)[::-1]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                if k.lower() == "articlebody" and isinstance(x, str) and x.strip():
                    text = x if "<" not in x else parse(x).text()
                    return V.normalize(text)
            todo += [x for x in v.values() if isinstance(x, (dict, list))][::-1]
        elif isinstance(v, list):
            todo += v[::-1]
    return None


def product_text(blocks) -> str | None:
    best, todo = None, list(blocks)
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            d = v.get("description")
            if {"Product", "SoftwareApplication"} & set(M.ld_types(v)) and isinstance(d, str) and len(d.strip()) > len(best or ""):
                best = V.clean(d if "<" not in d else parse(d).text())
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return best


def discourse(doc: Node) -> str | None:
    """HTML of the posts in a forum's preloaded JSON (a JSON object whose values are JSON texts)."""
    n = doc.first("[data-preloaded]")
    try:
        outer = json.loads(n.get("data-preloaded")) if n else {}
        out = []
        for k, v in outer.items():
            if k.startswith("topic_"):
                topic = json.loads(v) if isinstance(v, str) else v
                out += [p.get("cooked", "").strip() for p in topic.get("post_stream", {}).get("posts", [])]
    except (ValueError, AttributeError, TypeError):
        return None
    return "\n\n".join(x for x in out if x) or None


def starts_as_boilerplate(text: str) -> bool:
    """Whether a text begins with a notice, or with many short lines as menus do."""
    head = text.lower()[:200]
    return any(w in head for w in ("cookie", "consent", "©", "copyright")) or head.count("\n") > len(head.split()) // 3


def document_language(doc: Node) -> str | None:
    """The language that the document declares: on its root, as a header, or by name."""
    said = [n.get("lang") for n in doc.by_tag("html")]
    for key in ("http-equiv", "name"):
        said += [m.get("content") for m in doc.by_tag("meta") if m.get(key).lower() == ("content-language" if key == "http-equiv" else "language")]
    return next((V.language(x) for x in said if x.strip()), None)


def baseline(doc: Node, body: Node) -> str:
    text = article_body(M.ld_blocks(doc))
    if text and len(text) > 100:
        return text
    for n in doc.select("aside, footer, div[id*='footer'], div[class*='footer'], nav, script, style"):
        n.remove()
    n = doc.first("article, story")
    if n and len(t := V.clean(n.text())) > 100:
        return t
    seen, out = set(), []
    for n in body.select("blockquote, pre, q, code, p"):
        if not R.discarded(n) and not any(R.discarded(a) for a in n.above() if a.tag) and (t := V.clean(n.spaced())) and t not in seen:
            seen.add(t)
            out.append(t)
    if len(t := "\n".join(out)) > 100:
        return t
    return V.clean(body.spaced()) or V.clean(doc.spaced())


def fallback(doc: Node, text: str, html: str | None, o: Options) -> tuple[str, str] | None:
    """A better text and its HTML; doc is the page before cleaning, which is changed."""
    for n in doc.select(P.SHARE_PLUGINS):
        n.remove()
    old = body_of(parse(html or ""))
    new = old.copy()
    for n in [n for n in new.elements() if n.tag in ("aside", "audio", "button", "fieldset", "figure", "footer", "iframe", "input", "label", "link", "nav", "noscript", "object", "option", "select", "source", "svg", "time")]:
        n.remove()
    found = V.clean(new.spaced())
    a, b = len(found), len(text)
    ptext = sum(len(p.spaced()) for p in old.select("p"))
    if usable(a, b, ptext, len(old.select("table")), len(old.select("p")), len(new.select("h2, h3, h4")), o) and a >= o.min_extracted_len:
        return found, f"<body>{render_html(new, o, False)}</body>"
    if b < o.min_extracted_len and not o.favor_precision:
        body = body_of(doc)
        if t := baseline(doc, body):
            return t, "<body>" + "".join(f"<p>{V.escape(x)}</p>" for x in t.split("\n") if x) + "</body>"
    return None


def usable(new: int, old: int, ptext: int, tables: int, paragraphs: int, headings: int, o: Options) -> bool:
    least = o.min_extracted_size
    if not new or new == old:
        return False
    if not old or (old > 5 * new and new >= least):
        return True
    if old > 2 * new:
        return new >= least and (ptext * 100 / old < 40 or old > 3 * new)
    if new > 2 * old or (ptext == 0 and new > 2 * least) or (tables > paragraphs and new > 2 * least):
        return True
    return o.favor_recall and ((headings > 0 and new > old) or old < least)


def merged(doc: Node, body: Node, o: Options) -> str | None:
    """Text of several good nodes of a page whose content is spread."""
    whole = max(V.size(V.clean(body.text())), 1)
    found = [(s, n) for n in body.elements() if n.tag in ("div", "section", "article", "main") for s, size in [node_score(n)] if size >= 50 and size <= 0.85 * whole]
    found.sort(key=lambda x: -x[0])
    out, seen, total = [], [], 0
    for s, n in found:
        if s < found[0][0] / 5 or total >= 15_000:
            break
        text = render_text(n, o)
        own = set(text.split())
        if not own or any(len(own & x) > 0.7 * min(len(own), len(x)) for x in seen):
            continue
        if total + V.size(text) <= 15_000:
            out.append(text)
            seen.append(own)
            total += V.size(text)
    return "\n\n".join(out) if len(out) >= 2 else None


def repeated_items(doc: Node) -> str | None:
    groups = [[n for n in c.kids if n.tag in ("article", "li")] for c in doc.select("main, #main, #content, .content, [role='main'], ul, ol, section, div")] + [doc.select("article")]
    best = ""
    for g in groups:
        texts = [t for n in g if len((t := V.clean(n.spaced())).split()) >= 15]
        if len(texts) >= 3 and len(t := "\n\n".join(texts)) > len(best):
            best = t
    return best or None


COLLECTION = ".collection-description, .category-description, .collection__description, .category__description, .collection-intro, .category-intro, .page-description, .term-description, .taxonomy-description, .archive-description, .seo-text"
NAV_WORDS = ("home", "menu", "about", "contact", "login", "search", "navigation")


def images(node: Node, og: str | None) -> list[dict]:
    out: list[dict] = []

    def put(img: Node, caption: str | None):
        src = img.get("src") or img.get("data-src")
        if src and all(x["src"] != src for x in out):
            out.append({"src": src, "filename": V.file_name(src), "alt": img.get("alt") or None, "caption": caption, "is_hero": False})

    for f in node.select("figure"):
        if img := f.first("img"):
            c = f.first("figcaption")
            put(img, V.clean(c.text()) or None if c else None)
    for img in node.select("img"):
        put(img, None)
    if out:
        name = V.file_name(og or "").lower()
        hero = next((x for x in out if og and name and x["filename"].lower() == name), None) or next((x for x in out if x["src"] == og), None) or out[0]
        hero["is_hero"] = True
    return out


def comment_section(doc: Node, body: Node) -> Node | None:
    for css in [f"#{x}" for x in P.COMMENT_IDS] + [f".{x}" for x in P.COMMENT_CLASSES]:
        if n := doc.first(css):
            return n
    found = [n for n in body.with_attrs() if R.COMMENT_ID.match(n.get("id")) or (n.get("class") and R.COMMENT_CLASS.search(n.get("class")))]
    return max(found, key=lambda n: V.size(V.clean(n.text())), default=None)


# ---------------------------------------------------------------- a page
EMPTY = {"content_text": "", "content_html": None, "content_markdown": None, "comments_text": None, "comments_html": None, "images": [], "classification_confidence": None, "extraction_quality": 0.0}


def extract(html: str, o: Options | None = None) -> dict:
    """The record of a page. A page that has no content gives a warning, never an error."""
    o = o or Options()
    html = html or ""
    doc = parse(html)
    body = body_of(doc)
    meta = M.metadata(doc, body, o.url, o.author_blacklist)
    warnings: list[str] = []
    if o.page_type:
        kind, confidence = V.page_type(o.page_type), None
    else:
        url_kind = V.url_type(o.url)
        kind = M.refine(url_kind, M.signals(doc, body, meta["og_type"]))
        confidence = 1.0 if url_kind != "article" else 0.95 if kind != "article" else 0.5  # our rule: no trained model is used
    meta.pop("og_type")
    meta["page_type"] = kind
    profile, source = P.PROFILES[kind], cache(lambda: parse(html))  # the page before cleaning, for what needs it
    blocks = M.ld_blocks(doc)
    body_ld, product, posts = article_body(blocks), product_text(blocks), discourse(doc) if kind == "forum" else None
    if profile.comments_are_content:
        o = o.with_(include_comments=True)
    page_lang = document_language(doc)
    clean(doc, body, o, profile)
    found = main_content(doc, body, o, profile, meta["title"], page_lang)
    text, content = (found[0], found[1]) if found else ("", None)
    if not found:
        warnings.append("Content extraction failed - no main content found")
    old = len(text)
    p, tables = (len(re.findall("<p[> ]", content or "")), (content or "").count("<table"))
    nav = sum(w in text[:100].lower() for w in NAV_WORDS) >= 3
    if o.use_fallback_extraction and (old < o.min_extracted_len or not p or tables >= p or V.count_words(text, o.min_word_length) < o.min_output_size or nav) and (got := fallback(source().copy(), text, content, o)):
        text, content = got
        warnings.append(f"Used fallback extraction: {len(text)} chars (was {old} chars)")
    if profile.aggregate and len(text) < 3000 and (t := merged(doc, body, o)) and 2 * len(text) < len(t) <= 15_000:
        warnings.append(f"Used multi-candidate merge: {len(t)} chars (was {len(text)} chars)")
        text, content = t, None
    if profile.repeated and len(text) < 3000 and (t := repeated_items(source())) and len(t) > 2 * len(text):
        warnings.append(f"Used repeated-item collection: {len(t)} chars (was {len(text)} chars)")
        text, content = t, None
    if kind == "collection":
        t = max((V.clean(n.text()) for n in source().select(COLLECTION)), key=len, default="")
        if len(t.split()) >= 10 and len(t) >= 50 and t.lower()[:60] not in text.lower():
            text, content = f"{t}\n\n{text}", None
    if product and kind == "product":
        own = set(product.split())
        share = len(own & set(text.split())) / max(len(own), 1)
        if len(text) < 100 or (len(text) < 500 and len(product) >= 100 and share < 0.2):
            warnings.append(f"Using JSON-LD Product description: {len(product)} chars (DOM was {len(text)} chars, overlap {100 * share:.0f}%)")
            text, content = product, None
    for name, t in (("Discourse", posts), ("JSON-LD", body_ld)):
        if t and len(t) >= 500:
            if len(text) < 200 or len(t) > 2 * len(text) or starts_as_boilerplate(text):
                warnings.append(f"Using {name} content: {len(t)} chars (DOM was {len(text)} chars)")
                text, content = (V.normalize(parse(t).text()), t) if name == "Discourse" else (t, "<p>" + t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") + "</p>")
            break
    out = dict(EMPTY, warnings=warnings, metadata=meta, classification_confidence=confidence)
    if o.include_comments and (n := comment_section(doc, body)) is not None:
        out["comments_text"], out["comments_html"] = render_text(n, o, False) or None, render_html(n, o, False) or None
    if o.include_images:
        node = content_node(doc, body, Options(), P.Profile(), page_lang)
        out["images"] = (images(node, meta["image"]) if node else []) or images(body, meta["image"])
    out["extraction_quality"] = V.quality(text, content, V.size(html), kind)
    if o.output_markdown and content is not None:
        out["content_markdown"] = render_markdown(found[2] if found and found[2] and content is found[1] else body_of(parse(content)), o)
    if V.count_words(text, o.min_word_length) < o.min_output_size or V.size(text) < o.min_extracted_len:
        warnings.append(f"Insufficient content after extraction: {V.count_words(text, o.min_word_length)} words (min: {o.min_output_size}), {V.size(text)} chars (min: {o.min_extracted_len})")
    if V.size(text) > o.max_extracted_len:
        text = text.encode()[: o.max_extracted_len].decode("utf-8", "ignore")
        warnings.append(f"Content truncated to max length: {o.max_extracted_len}")
    if out["comments_text"] and V.count_words(out["comments_text"], o.min_word_length) < o.min_output_comm_size:
        warnings.append(f"Comments section removed: {V.count_words(out['comments_text'], o.min_word_length)} words (min: {o.min_output_comm_size})")
        out["comments_text"] = out["comments_html"] = None
    return out | {"content_text": text, "content_html": content}
