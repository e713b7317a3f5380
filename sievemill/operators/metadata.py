"""Metadata of a page: URL, JSON-LD, meta tags, then the document, each filling what is still empty."""

from __future__ import annotations

import json
import re

from . import profiles as P
from . import rules as R
from . import values as V
from .dom import Node

PERSON, ORGANIZATION = {"person"}, {"organization", "website", "publisher", "newsmediaorganization", "corporation"}
LISTS = ("categories", "tags")
TITLE_CUT = re.compile(r"\s*[|–—·]\s*|\s+-\s+|\s*:\s+")
SITE_CUT = re.compile(r"\s*[|–—]\s*|\s+-\s+")


def ld_blocks(doc: Node) -> list:
    out = []
    for s in doc.select("script[type='application/ld+json']"):
        try:
            out.append(json.loads(s.text().strip()))
        except (ValueError, RecursionError):
            continue
    return out


def ld_types(value) -> list[str]:
    t = value.get("@type")
    return [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]


def walk_ld(value, depth=0, parent=False):
    """(importance, types, data) of every typed object, keys in order."""
    if isinstance(value, list):
        for v in value:
            yield from walk_ld(v, depth, parent)
    elif isinstance(value, dict):
        types = [t.lower() for t in ld_types(value)]
        if types:
            article = any(t.endswith("article") or t in ("blogposting", "newsarticle", "report") for t in types)
            yield (100 if article else 50) - 10 * depth + 5 * parent, types, value
        for k in sorted(value):
            if isinstance(value[k], (dict, list)):
                yield from walk_ld(value[k], depth + bool(types), parent or bool(types))


def _string(v) -> str | None:
    if isinstance(v, str) and v.strip():
        return v.strip()
    if isinstance(v, list) and v:
        return _string(v[0])
    if isinstance(v, dict):
        return _string(v.get("name")) or _string(v.get("url")) or _string(v.get("@value"))
    return None


def _strings(v) -> list[str]:
    return V.tag_list(v, ",") if isinstance(v, str) else [s for x in v if (s := _string(x))] if isinstance(v, list) else []


def from_ld(doc: Node, put) -> None:
    found = sorted(walk_ld(ld_blocks(doc)), key=lambda x: -x[0])
    for _, types, d in found:
        if PERSON & set(types):
            put("author", _string(d.get("name")) or V.clean(f"{_string(d.get('givenName')) or ''} {_string(d.get('familyName')) or ''}") or None)
    for _, types, d in found:
        if ORGANIZATION & set(types):
            put("sitename", _string(d.get("name")))
    for _, types, d in found:
        if any(t.endswith("article") or t in ("blogposting", "report") for t in types):
            put("title", _string(d.get("headline")) or _string(d.get("name")))
            put("description", _string(d.get("description")))
            put("date", (s := _string(d.get("datePublished"))) and V.date(s, V.DATES[:2]))
            image = d.get("image")
            image = image[0] if isinstance(image, list) and image else image
            put("image", _string(image.get("url")) if isinstance(image, dict) else _string(image))
            put("categories", _strings(d.get("keywords")))


def from_meta(doc: Node, put) -> None:
    for m in doc.select("meta"):
        name = next((m.get(k) for k in ("name", "property", "itemprop", "http-equiv") if m.get(k)), "").lower()
        value = m.get("content").strip()
        field = P.META_FIELD.get(name)
        if not field or not value:
            continue
        if field == "author" and not V.is_name(value):
            continue
        put(field, V.date(value) if field == "date" else V.tag_list(value) if field in LISTS else value.split("_")[0].lower() if field == "language" else V.license_name(value) if field == "license" else value)


def title_of(doc: Node) -> str | None:
    t = doc.first("title")
    text = t.text().strip() if t else ""
    if not text:
        return None
    parts = TITLE_CUT.split(text)
    if len(parts) > 1:
        best = max(enumerate(parts), key=lambda p: (V.size(p[1]), p[0]))[1].strip()
        if V.size(best) > 10:
            return best
    return text


def first_h1(doc: Node) -> str | None:
    return next((t for h in doc.select("h1") if 5 < V.size(t := V.clean(h.spaced())) < 200), None)


def from_document(doc: Node, put, body: Node) -> None:
    title, h1 = title_of(doc), first_h1(doc)
    if title and h1 and h1.lower() in title.lower():
        put("title", h1)
    put("title", title or h1)
    for rule in R.TITLE:
        n = next(rule.within(body), None)
        if n and V.size(t := V.clean(n.spaced())) > 5:
            put("title", t)
    for rule in R.AUTHOR:
        n = next((n for n in rule.within(body) if not any(x.holds(n) for x in R.AUTHOR_DISCARD)), None)
        if n and 2 <= V.size(t := V.clean(n.spaced())) < 150:
            put("author", V.author(t))
    dates = [n.get("datetime") for n in doc.select("time[datetime]")] + [n.text().strip() for n in doc.select("time")]
    for place in P.DATE_PLACES:
        for n in doc.select(place)[:3]:
            dates += [n.get("datetime"), n.get("content"), *([t] if V.size(t := n.text().strip()) < 100 else [])]
    put("date", next((d for s in dates if s and (d := V.date(s))), None))
    canonical = doc.first("link[rel='canonical']")
    if canonical and V.host(canonical.get("href")):
        put("url", canonical.get("href"))
    t = doc.first("title")
    parts = SITE_CUT.split(t.text().strip()) if t else []
    if len(parts) > 1 and 3 <= V.size(parts[-1].strip()) < 50:
        put("sitename", parts[-1].strip())
    for rule in R.SITENAME:
        n = next(rule.within(body), None)
        if n and 0 < V.size(t := n.spaced()) < 100:
            put("sitename", t)
    for field, found, most in (("categories", R.CATEGORIES, 5), ("tags", R.TAGS, 10)):
        out: list[str] = []
        for rule in found:
            for n in rule.within(doc):
                texts = [n.get("content")] if n.tag == "meta" else [a.text() for a in n.select("a")] or [n.text()]
                for x in (x for t in texts for x in V.tag_list(t, "[,;/]")):
                    if V.size(x) < 100 and x not in out:
                        out.append(x)
            if len(out) >= most:
                break
        put(field, out)
    links = [a for place in P.LICENSE_PLACES for n in doc.select(place) for a in n.select("a")] + doc.select("a[rel='license']")
    put("license", next((f"CC {m[1].upper()}" for a in links if (m := re.search(r"creativecommons\.org/licenses/([a-z-]+)/", a.get("href")))), None))
    html = doc.first("html")
    put("language", html.get("lang").split("-")[0].lower() if html and html.get("lang") else None)


def metadata(doc: Node, body: Node, url: str | None, blacklist: tuple[str, ...] = ()) -> dict:
    out: dict = dict.fromkeys("title author url hostname description sitename date id fingerprint license language image page_type og_type".split()) | {"categories": [], "tags": []}

    def put(field, value):
        if value and not out[field]:
            out[field] = value

    put("url", url)
    from_ld(doc, put)
    from_meta(doc, put)
    from_document(doc, put, body)
    for k in ("title", "author", "description", "sitename"):
        if out[k]:
            out[k] = V.decode(out[k].strip()) or None
    if out["title"]:
        out["title"] = V.strip_site(out["title"], out["sitename"])
    for k, more in (("url", ()), ("image", ("data:",))):
        if out[k] and not (V.host(out[k]) or out[k].startswith(("/", *more))):
            out[k] = None
    if out["author"] and any(b.lower() in out["author"].lower() for b in blacklist):
        out["author"] = None
    out["hostname"] = V.host(out["url"])
    return out


def signals(doc: Node, body: Node, og_type: str | None) -> dict:
    """What the page says of its type."""
    classes = [n.get("class").lower() for n in doc.with_attrs() if n.get("class")]
    has = lambda words: any(w in c for c in classes for w in words)
    types: list[str] = []
    aggregate = False
    for block in ld_blocks(doc):
        todo = [block]
        while todo:
            v = todo.pop()
            if isinstance(v, dict):
                types += ld_types(v)
                aggregate |= "AggregateOffer" in ld_types(v)
                todo += v.values()
            elif isinstance(v, list):
                todo += v
    code = len(doc.select("pre, code"))
    words = sum(len(p.text().split()) for p in doc.select("p"))
    paragraphs = len(doc.select("p"))
    links = len(doc.select("a"))
    return {
        "og_type": og_type,
        "ld_types": types,
        "has_aggregate_offer": aggregate,
        "has_product_grid": has(P.PRODUCT_GRID),
        "has_add_to_cart": has(P.CART) or any(any(w in b.text().lower() for w in P.CART_TEXT) for b in doc.select("button, a, input")),
        "product_element_count": sum(any(w in c for w in P.PRODUCT_ITEM) for c in classes),
        "has_pagination": bool(doc.select("link[rel='next'], link[rel='prev']")) or has(P.PAGINATION) or any("pagination" in n.get("aria-label").lower() or "paging" in n.get("aria-label").lower() for n in doc.select("nav[aria-label]")),
        "code_block_count": code,
        "has_docs_nav": has(P.DOCS_NAV) or (code >= 10 and has(("sidebar",))),
        "link_ratio": links / max(paragraphs, 1),
        "paragraph_word_count": words,
    }


def refine(kind: str, s: dict) -> str:
    """The URL's type, or for articles what the page's signals say."""
    if kind != "article":
        return kind
    types, og, many = set(s["ld_types"]), (s["og_type"] or "").lower(), s["product_element_count"] >= 5
    product = bool(types & {"Product", "ProductGroup"})
    if types & {"CollectionPage", "OfferCatalog", "ProductCollection"} or (product and s["has_aggregate_offer"]) or ("ItemList" in types and (s["has_product_grid"] or many)):
        return "collection"
    group = og in ("product.group", "product:group")
    if group or (many and (s["has_pagination"] or (s["has_product_grid"] and s["has_add_to_cart"]))):
        return "collection"
    if not s["has_aggregate_offer"] and (product or "product" in og):
        return "collection" if s["has_product_grid"] and not product else "product"
    if s["has_product_grid"] and s["has_add_to_cart"]:
        return "collection"
    if (s["has_docs_nav"] and s["code_block_count"] >= 3) or s["code_block_count"] >= 500:
        return "documentation"
    return "listing" if s["link_ratio"] >= 3.0 and s["paragraph_word_count"] < 30 else "article"
