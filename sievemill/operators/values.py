"""The string functions of `functions.columns` for use within a page, where a result feeds back into the tree. A test holds both against each other."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from urllib.parse import urljoin, urlsplit

from ..functions import lists

_SPACE = r"\x09-\x0d \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]+")


def size(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))


def language(s: str) -> str:
    """The language of a tag such as de-AT or de_AT."""
    return re.split("[-_]", s.strip())[0].lower()


TYPE_NAMES = {"category": "collection", "docs": "documentation"}


def page_type(name: str) -> str:
    """A page type by any of its names, in any case."""
    kind = TYPE_NAMES.get(name.strip().lower(), name.strip().lower())
    if kind not in lists.PAGE_TYPES:
        raise ValueError(f"unknown page type: {name}")
    return kind


IMAGE_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico", "tiff", "tif", "avif")


def is_image_file(src: str) -> bool:
    return src.split("?")[0].split(".")[-1].lower() in IMAGE_ENDINGS


def strip(s: str) -> str:
    return re.sub(f"^[{_SPACE}]+|[{_SPACE}]+$", "", s)


def clean(s: str) -> str:
    return _RUN.sub(" ", s).strip(" ")


def normalize(s: str) -> str:
    s = re.sub("[ \t]+", " ", s.replace("\r", ""))
    s = re.sub(" ?\n ?", "\n", re.sub(" ([.,;:!?])", r"\1", s))
    return strip(re.sub("\n{3,}", "\n\n", s))


def escape(s: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = s.replace(raw, entity)
    return s


def decode(s: str) -> str:
    for entity, raw in lists.ENTITIES:
        s = s.replace(entity, raw)
    return s


def titles_match(a: str, b: str) -> bool:
    a, b = clean(a.lower()), clean(b.lower())
    if not a or not b:
        return False
    if a == b:
        return True
    for x, y in ((a, b), (b, a)):
        for s in (" - ", " | ", " – ", " — ", ": "):
            if (s in x and x.split(s)[0] == y) or (x.startswith(y + s) and size(x) > size(y) + 3):
                return True
    return False


def strip_site(title: str, site: str | None) -> str:
    for sep in (" | ", " • ", " » ", " - ", " – ", " — "):
        at = title.find(sep)
        while at >= 0:
            head, tail = title[:at].strip(), title[at + len(sep) :].strip()
            if site:
                if tail.lower().startswith(site.lower()) and head:
                    return head
                if head.lower() == site.lower() and tail:
                    return tail
            if len(tail.split()) <= 5 and size(tail) < 35 and size(head) > 10:
                return head
            if len(head.split()) <= 2 and size(head) < 20 and size(tail) > size(head):
                return tail
            at = title.find(sep, at + len(sep))
    return title


#: what stands in Markdown as markup, or is protected already; else a special character is text
_MARKDOWN = re.compile(
    r"""(?P<keep>^`{3,}[\s\S]*?(?:^`{3,}|\Z)|`[^`]*(?:`|\Z)|\\[\\*_\[\]<>]?"""  # code, escapes
    r"""|^[ \t]*(?:[#>]|[-*+](?=[ ]))|(?<=>[ ])>"""  # headings, quotes, lists
    r"""|\*\*|__|(?:(?<=[^\W_])|(?<=\s)|^)[*_](?=[^\W_])|(?<=[^\W_])[*_](?=\s|\Z)"""  # strong, emphasis
    r"""|\[(?=[\s\S]*\]\()|\](?=\()|<(?=[h/]))|[*_\[\]<>]""",  # links
    re.M,
)


def escape_loose_markdown(s: str) -> str:
    """Backslashes before special characters of a Markdown document that are no markup (deprecated: the writer escapes text by itself)."""
    return _MARKDOWN.sub(lambda m: m[0] if m["keep"] is not None else "\\" + m[0], s)


def count_words(s: str, least: int) -> int:
    return sum(1 for w in s.split() if len(w) >= least or size(w) >= least)


def sentences(s: str) -> int:
    return len(re.findall("[.!?]+", s))


def is_share(text: str) -> bool:
    t = strip(text)
    n, s = size(t), re.sub(r"^[^\w]+", "", t)
    low = s.lower()
    if re.match(f"(?:{'|'.join(lists.SHARE_NAMES)})(?![^\\W_])", s) or low.startswith(lists.SHARE_STARTS) or low in lists.SHARE_WHOLE:
        return True
    if "subscribe" in low and "newsletter" in low:
        return True
    if n < 120 and (low.startswith(lists.PHOTO_STARTS) or any(w in low for w in lists.PHOTO_AGENCIES)):
        return True
    if n < 80 and low.startswith(lists.NEWS_STARTS + lists.DATE_STARTS):
        return True
    return n < 50 and low.startswith("by ") and t[3:4].isupper() and ". " not in t[3:] and ", the " not in t[3:]


def is_name(s: str) -> bool:
    t = strip(s)
    n = size(t)
    return 2 <= n <= 120 and not (n > 20 and " " not in t) and not t.startswith(("http://", "https://", "www.", "{", "[")) and not any(w in t for w in (".com", ".org", ".net")) and sum(c in "0123456789" for c in t) <= 3 and sum(not c.isalnum() and not c.isspace() and c not in "-'." for c in t) <= 2


def author(s: str) -> str | None:
    s = re.sub(r"^(Written by |By |by )", "", clean(s))
    s = re.sub(r"@\w+", "", re.sub(r"\S+@\S+\.\S+", "", s))
    s = clean(re.sub(r"(?i)\s+and\s+\d+\s+more.*$", "", s))
    return s if size(s) >= 2 else None


def tag_list(s: str, separators: str = "[,;]") -> list[str]:
    return [t for t in (clean(x) for x in re.split(separators, s)) if t]


def license_name(s: str) -> str:
    t = clean(s)
    low = t.lower()
    if "creativecommons.org/publicdomain/zero" in low or t.upper() == "CC0":
        return "CC0 1.0"
    m = re.search(r"creativecommons\.org/licenses/([a-z-]+)/([0-9.]+)", low)
    return f"CC {m[1].replace('-', ' ').upper()} {m[2]}" if m else t


DATES = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y")


def date(s: str, formats: tuple[str, ...] = DATES) -> datetime | None:
    """RFC 3339 first, then the formats in order."""
    s = clean(s)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})", s):
        try:
            return datetime.fromisoformat(s.replace("Z", "+00:00")).astimezone(timezone.utc)
        except ValueError:
            return None
    for f in formats:
        try:
            return datetime.strptime(s, f).replace(tzinfo=timezone.utc)
        except ValueError:
            continue
    return None


def host(url: str | None) -> str | None:
    m = re.match(r"https?://(?:[^/?#@]*@)?([^/?#:@]+)", (url or "").strip())
    return m[1].lower() if m else None


def absolute(url: str, base: str | None) -> str:
    if not url or url.startswith(("data:", "javascript:", "mailto:", "tel:")) or host(url) or not base:
        return url
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def file_name(url: str) -> str:
    name = url.strip().split("?")[0].split("#")[0].split("/")[-1]
    return "" if name in (".", "..") else name


def url_type(url: str | None) -> str:
    low = (url or "").lower()
    if not low:
        return "article"
    rest = re.sub("^https?://", "", low)
    domain, _, tail = rest.partition("/")
    path = "/" + tail
    has = lambda x, words: any(w in x for w in words)
    if has(domain, lists.FORUM_DOMAINS) or has(path, lists.FORUM_PATHS) or has(low, lists.FORUM_URLS):
        return "forum"
    if has(domain, lists.DOCS_DOMAINS) or has(path, lists.DOCS_PATHS):
        return "documentation"
    if has(path, lists.PRODUCT_PATHS) or has(domain, lists.PRODUCT_DOMAINS):
        return "product"
    if has(path, lists.CATEGORY_PATHS):
        return "collection"
    if has(path, lists.SERVICE_PATHS) or has(low, lists.SERVICE_SLUGS):
        return "service"
    if path.rstrip("/").endswith(lists.LISTING_ENDINGS) or has(path, lists.LISTING_PATHS):
        return "listing"
    return "article"


def is_absolute(url: str) -> bool:
    return host(url) is not None and bool(urlsplit(url.strip()).scheme)


def quality(text: str, html: str | None, html_bytes: int, kind: str) -> float:
    n, score = size(text), 1.0
    if html_bytes > 0:
        ratio = n / html_bytes
        score += -0.30 if ratio < 0.005 else -0.20 if ratio < 0.01 else -0.10 if ratio < 0.02 else 0.0
        score += -0.10 if ratio > 0.30 else 0.0
    low, middle = lists.EXPECTED_LENGTH[kind]
    score += -0.30 if n < 100 else -0.20 if n < low // 2 else -0.10 if n < low else 0.0
    score += 0.05 if low <= n <= middle * 3 else 0.0
    if html is not None:
        score += -0.20 if not re.search("<p[> ]", html) and n > 200 else 0.0
        share = sum(size(x) for x in re.findall("(?s)<a [^>]*>(.*?)</a>", html)) / n if n else 0.0
        score += -0.25 if share > 0.5 else -0.10 if share > 0.3 else 0.0
    else:
        score += -0.05 if n > 200 else 0.0
    head = text[:200].lower()
    hits = sum(w in head for w in lists.QUALITY_WORDS)
    score += -0.25 if hits >= 2 else -0.10 if hits == 1 else 0.0
    return min(max(score, 0.0), 1.0)
