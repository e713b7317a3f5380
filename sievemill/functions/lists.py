"""Word lists and patterns that results depend on."""

# Parts of URLs by page type
FORUM_DOMAINS = ("forum.", "forums.", "community.", "discuss.", "discussion.", "users.", "bbs.", "reddit.com", "stackoverflow.com", "stackexchange.com", "gamefaqs.", "discourse.", "news.ycombinator.com", "quora.com", "lemmy.", "tapatalk.com", "webhostingtalk.com", "netmums.com", "mumsnet.com", "nairaland.com", "lobste.rs")
FORUM_PATHS = ("/forum", "/forums/", "/thread/", "/threads/", "/topic/", "/topics/", "/discussion/", "/discussions/", "/community/", "/t/", "/questions/", "/question/", "/comments/", "/talk/")
FORUM_URLS = ("/viewtopic.php", "/showthread.php", "/item?id=")
DOCS_DOMAINS = ("docs.", "doc.", "wiki.", "devdocs.", "man7.org", "readthedocs.io", "readthedocs.org", "developer.hashicorp.com", "developer.mozilla.org")
DOCS_PATHS = ("/docs/", "/doc/", "/documentation/", "/reference/", "/api/", "/guide/", "/tutorial/", "/tutorials/", "/manual/", "/handbook/", "/wiki/", "/man-pages/", "/man/", "/concepts/", "/userguide/", "/quickstart", "/getting-started", "/book/", "/glossary/", "/tech_notes/")
PRODUCT_PATHS = ("/products/", "/product/", "/shop/", "/dp/", "/ip/")
PRODUCT_DOMAINS = ("shop.", "store.")
CATEGORY_PATHS = ("/collections/", "/collection/", "/categories/", "/category/", "/browse/", "/cat/", "/subcategory/")
SERVICE_PATHS = ("/services/", "/service/", "/services.html", "/solutions/", "/solution/", "/offerings/", "/what-we-do")
SERVICE_SLUGS = ("-consulting-services", "-development-services", "-management-services", "-support-services", "-outsourcing-services", "-integration-services", "-development-company", "-consulting-company", "-ai-consulting", "-ai-development", "-ai-solutions")
LISTING_ENDINGS = ("/news", "/testimonials", "/coupons", "/issues", "/reviews", "/rankings", "-courses")
LISTING_PATHS = ("/awards/", "/trending/", "/list/")
PAGE_TYPES = ("article", "forum", "product", "collection", "listing", "documentation", "service")

# Expected content bytes (low, middle) by page type
EXPECTED_LENGTH = {"article": (1500, 5000), "forum": (1000, 4000), "product": (300, 1500), "collection": (500, 3000), "listing": (1000, 5000), "documentation": (2000, 8000), "service": (1500, 5000)}
QUALITY_WORDS = ("cookie", "consent", "subscribe", "newsletter", "sign up", "skip to content", "skip to main", "©", "copyright", "privacy policy", "terms of", "accept all")

# Entities in the order in which they are replaced
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#8211;", "–"), ("&#8212;", "—"), ("&#8217;", "’"), ("&#8216;", "‘"), ("&#8220;", "“"), ("&#8221;", "”"), ("&bull;", "•"), ("&#187;", "»"), ("&raquo;", "»"), ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "’"), ("&lsquo;", "‘"))

# Names of share buttons; sentences that begin or are such texts
SHARE_NAMES = ("Drucken", "E-Mail", "Email", "EMail", "Facebook", "Flipboard", "Google", "Instagram", "Linkedin", "LinkedIn", "Mail", "PDF", "Pinterest", "Pocket", "Print", "QQ", "Reddit", "Twitter", "WeChat", "WeiBo", "Weibo", "Whatsapp", "WhatsApp", "Xing", "XING")
SHARE_STARTS = ("more on this", "mehr zum thema", "click here to subscribe", "sign up for", "join our newsletter", "breaking news emails", "get breaking news")
SHARE_WHOLE = ("comments", "comment", "kommentare", "subscribe", "enlarge image", "view image", "click to enlarge", "zoom", "view gallery", "view photos")
PHOTO_STARTS = ("photo:", "photo by", "image:", "image by", "credit:", "source:")
PHOTO_AGENCIES = ("getty images", "getty", "afp", "ap photo", "associated press", "shutterstock", "alamy", "rex features", "splash news", "wireimage", "filmmagic")
NEWS_STARTS = ("reuters,", "pti,", "ians,", "ani,", "xinhua,", "staff reports", "staff report", "staff writer", "special to")
DATE_STARTS = ("updated:", "published:", "last updated", "posted:", "date:")
