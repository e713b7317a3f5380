"""The 89 numbers of a page for a page-type model, named. URL parts and counts come from tables of fixed values."""

from __future__ import annotations

import re
from collections import Counter

from ..functions import lists as L
from . import values as V
from .dom import Node

# Further URL words
ARTICLE_PATHS = ("/blog/", "/blog", "/news/", "/article/", "/articles/", "/post/", "/posts/", "/insight/", "/insights/", "/resource/", "/resources/", "/stories/", "/magazine/", "/journal/", "/press/", "/editorial/", "/opinion/", "/review/", "/column/")
BLOG_SLUGS = ("-ways-to-", "-tips-", "-reasons-", "-steps-to-", "-things-to-", "-best-", "-top-", "-essential-", "beginners-guide", "complete-guide", "ultimate-guide", "how-to-", "what-is-", "why-", "when-to-", "-vs-", "-versus-", "-comparison", "-checklist", "-trends-", "-strategies-", "-challenges-", "-benefits-", "-advantages-")
# Feature -> (part of the URL, words)
URL = {
    "forum_domain": ("domain", L.FORUM_DOMAINS), "forum_path": ("path", L.FORUM_PATHS), "forum_url": ("url", L.FORUM_URLS), "docs_domain": ("domain", L.DOCS_DOMAINS), "docs_path": ("path", L.DOCS_PATHS),
    "product_path": ("path", L.PRODUCT_PATHS), "category_path": ("path", L.CATEGORY_PATHS), "service_path": ("path", L.SERVICE_PATHS), "service_slug": ("url", L.SERVICE_SLUGS), "article_path": ("path", ARTICLE_PATHS), "blog_slug": ("url", BLOG_SLUGS),
}
# Words in JSON-LD scripts
LD = {"ld_article": ("Article", "NewsArticle", "BlogPosting"), "ld_product": ("Product",), "ld_faq": ("FAQPage",), "ld_collection": ("CollectionPage", "OfferCatalog"), "ld_item_list": ("ItemList",), "ld_business": ("LocalBusiness",), "ld_service": ("Service",), "ld_aggregate_offer": ("AggregateOffer",)}
# Selectors; 1 if any element matches
ANY = {
    "has_article": "article", "has_time": "time", "has_main": "main", "has_aside": "aside", "has_author": "meta[name='author'], meta[property='article:author'], [class*='author']",
    "has_product_grid": "[class*='product-grid'], [class*='product-list'], [class*='product-card']", "has_cart": "[class*='add-to-cart'], [class*='addtocart'], [class*='buy-now']",
    "has_pages": "link[rel='next'], [class*='pagination'], [class*='pager']", "has_docs_nav": "[class*='docs-sidebar'], [class*='doc-sidebar'], [class*='docs-nav'], [class*='table-of-contents']",
    "has_hero": "[class*='hero']", "has_testimonial": "[class*='testimonial']", "has_pricing": "[class*='pricing']", "has_feature": "[class*='feature']", "has_breadcrumb": "[class*='breadcrumb']",
    "noindex": "meta[name='robots'][content*='noindex']", "og_product_group": "meta[property='og:type'][content*='product.group']",
    "has_filter": "[class*='filter'][class*='sidebar'], [class*='filter'][class*='panel'], [class*='filter'][class*='bar'], [class*='filter'][class*='menu']", "has_sort": "[class*='sort'][class*='select'], [class*='sort'][class*='dropdown'], [class*='sort'][class*='control'], [class*='sort'][class*='option']",
}
# Selectors; the number of matches
COUNT = {
    "n_headings": "h1, h2, h3, h4, h5, h6", "n_products": "[class*='product-card'], [class*='product-tile'], [class*='product-item']", "n_code": "code, pre", "n_grid": "[class*='grid'], [class*='col-'], [class*='column'], [class*='card']", "n_svg": "svg",
    "n_forms": "form", "n_images": "img", "n_lists": "ul, ol", "n_tables": "table", "n_navs": "nav", "n_sections": "section", "n_buttons": "button", "n_inputs": "input", "n_comment": "[class*='comment']", "n_post": "[class*='post']", "n_message": "[class*='message']",
}
CALLS = ("get started", "free trial", "contact us", "sign up", "try free", "get pricing", "book a", "schedule")
# vocabularies
WORDS = {
    "commercial": "price buy cart shop order shipping delivery stock sale discount offer deal checkout payment warranty returns refund".split(),
    "editorial": "posted author published updated comments share tweet read article blog opinion editor journalist source according".split(),
    "technical": "api function parameter returns example syntax reference deprecated version module class method interface configuration install".split(),
    "forum": "reply thread post member joined reputation moderator admin quote likes views topic answered solution vote upvote".split(),
}
KIND_WORDS = ("item", "card", "product", "post", "entry", "result", "row", "cell")
CARDS = "[class*='product-card'], [class*='product-tile'], [class*='product-item'], [class*='product-grid-item'], [class*='grid-item'], [class*='collection-item']"
PRODUCTS_TOTAL = re.compile(r"\d+\s*(results|items|products|pieces)")
#: in the order of the vector
NAMES = (
    "forum_domain forum_path forum_url docs_domain docs_path product_path category_path service_path service_slug article_path blog_slug listing_ending listing_path shop_domain "
    "n_paragraphs mean_paragraph n_headings text_per_h2 has_article has_time has_main has_aside has_author ld_article ld_product ld_faq ld_collection ld_item_list ld_business ld_service ld_aggregate_offer "
    "og_product og_article og_website has_product_grid has_cart n_products has_pages n_code has_docs_nav links_per_word n_paragraph_words n_grid n_svg n_calls has_hero has_testimonial has_pricing has_feature has_breadcrumb "
    "n_forms n_images n_lists n_tables n_navs n_sections n_buttons n_inputs text_bytes n_hrefs n_comment n_post n_message "
    "most_equal_classes parents_of_equal_classes n_prices images_per_kb heading_evenness says_breadcrumbs repeated_links link_share_variance noindex path_parts "
    "most_equal_shapes parents_of_equal_shapes commercial editorial technical forum most_repeated_link repeated_links_again og_product_group has_filter has_sort says_product_total cards_with_price says_collection n_cards card_price_share"
).split()
LARGE = 500_000  # bytes of body text from which the dearer features stay 0


def _shape(n: Node) -> str:
    cls = n.get("class").lower()
    word = next((w for w in KIND_WORDS if w in cls), "")
    return f"{n.tag}|{word}" if word else n.tag


def features(doc: Node, body: Node, og_type: str | None, url: str | None) -> list[float]:
    low = (url or "").lower()
    domain, _, rest = re.sub("^https?://", "", low).partition("/")
    part = {"url": low, "domain": domain, "path": "/" + rest}
    f: dict[str, float] = dict.fromkeys(NAMES, 0.0)
    for k, (where, words) in URL.items():
        f[k] = any(w in part[where] for w in words)
    f["listing_ending"] = part["path"].rstrip("/").endswith(L.LISTING_ENDINGS)
    f["listing_path"] = any(w in part["path"] for w in L.LISTING_PATHS)
    f["shop_domain"] = any(w in domain for w in L.PRODUCT_DOMAINS)
    text, links, paragraphs = body.text(), doc.select("a"), doc.select("p")
    size = V.size(text)
    long = [n for p in paragraphs if (n := V.size(p.text().strip())) > 20]
    f["n_paragraphs"], f["mean_paragraph"] = len(long), sum(long) / max(len(long), 1)
    h2 = len(doc.select("h2"))
    f["text_per_h2"] = size / h2 if h2 else 0
    for script in doc.select("script[type='application/ld+json']"):
        t = script.text()
        for k, words in LD.items():
            f[k] = f[k] or any(f'"{w}"' in t for w in words)
    og = (og_type or "").lower()
    f["og_product"], f["og_article"], f["og_website"] = "product" in og, og == "article", og == "website"
    for k, css in COUNT.items():
        f[k] = len(doc.select(css))
    n_words = len("".join(p.text() for p in paragraphs).split())
    f["n_paragraph_words"], f["links_per_word"] = n_words, len(links) / n_words if n_words else 0
    f["n_calls"] = sum(any(w in n.text().lower() for w in CALLS) for n in doc.select("button, a"))
    f["text_bytes"], f["n_hrefs"] = size, len({a.get("href") for a in links if "href" in a.attrs})
    late = {"noindex", "og_product_group", "has_filter", "has_sort"}
    for k, css in ANY.items():
        if k not in late or size <= LARGE:
            f[k] = doc.first(css) is not None
    if size <= LARGE:
        _dear(f, doc, body, text, size, links, part["path"])
    return [float(f[k]) for k in NAMES]


def _dear(f: dict, doc: Node, body: Node, text: str, size: int, links: list[Node], path: str) -> None:
    near = [n for n in body.elements() if any(a is body for a, _ in zip(n.above(), range(3), strict=False))]
    for n in near:
        kids = [k for k in n.kids if k.tag]
        if len(kids) < 3:
            continue
        for names, most, parents in (([k.get("class") for k in kids if "class" in k.attrs], "most_equal_classes", "parents_of_equal_classes"), ([_shape(k) for k in kids], "most_equal_shapes", "parents_of_equal_shapes")):
            top = max(Counter(names).values(), default=0)
            if top >= 3:
                f[parents] += 1
                f[most] = max(f[most], top)
    low = text.lower()
    f["n_prices"] = sum(text.count(c) for c in "$€£")
    f["images_per_kb"] = f["n_images"] / (size / 1000) if size else 0
    levels = Counter(h.tag for h in doc.select("h1, h2, h3, h4, h5, h6"))
    f["heading_evenness"] = max(levels.values()) / len(levels) if levels else 0
    f["says_breadcrumbs"] = "breadcrumblist" in low
    repeats = Counter(t for a in links if V.size(t := a.text().strip().lower()) > 3)
    f["repeated_links"] = f["repeated_links_again"] = sum(n >= 3 for n in repeats.values())
    f["most_repeated_link"] = max(repeats.values(), default=0)
    shares = [1000 * len(n.select("a")) / s for n in doc.select("section, article, div") if (s := V.size(n.text().strip())) > 50]
    if len(shares) >= 3:
        mean = sum(shares) / len(shares)
        f["link_share_variance"] = sum((x - mean) ** 2 for x in shares) / len(shares)
    f["path_parts"] = sum(bool(x) for x in path.strip("/").split("/"))
    words = low.split()
    counts = Counter(words)
    for k, vocabulary in WORDS.items():
        f[k] = sum(counts[w] for w in vocabulary) / len(words) if words else 0
    f["says_product_total"] = bool(PRODUCTS_TOTAL.search(low))
    f["says_collection"] = "collectionpage" in low or "productcollection" in low
    cards = doc.select(CARDS)
    f["n_cards"] = len(cards)
    f["cards_with_price"] = sum(c.first("[class*='price'], [class*='cost'], [class*='amount']") is not None for c in cards)
    f["card_price_share"] = f["cards_with_price"] / len(cards) if cards else 0
