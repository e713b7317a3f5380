"""CSS selectors and names by page type, tag sets for cleaning and rendering."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    content: tuple[str, ...] = ()
    keep_tags: tuple[str, ...] = ()
    remove: str = ""
    comments_are_content: bool = False
    aggregate: bool = False
    repeated: bool = False


FORUM_REMOVE = ".message-cell--user, .message-actionBar, .message-attribution, .message-footer, .message-lastEdit, .message-userExtras, #ai-summary-block, .xfa-gptts-block, [class*='ai-summary'], .p-body-sidebar, .p-body-sidebarCol, .js-quickReply, .block-outer, .messageUserInfo, .messageUserBlock, .messageDetails, .dark_postrating, .extraUserInfo, .crawler-post-meta, [itemprop='interactionStatistic'], .post-likes, #related-topics, .more-topics__list, .votecell, .post-layout--left, .user-info, .user-gravatar32, #hot-network-questions, .js-post-menu, #post-form, .related, #sidebar, .comments, .post-signature, .ipsComment_author, .cAuthorPane, .ipsComment_tools, .ipsComment_meta, .ipsComment_badges, .ipsSideMenu, .ipsWidget, [data-role='replyArea'], .pagetop, .yclinks, .morelink, td.subtext, .comhead, .votelinks, td.ind, .fatitem .title, aside.onebox, .bbCodeBlock--quote, .bbCodeBlock--expandable, .postprofile, dl.postprofile, .tagline, .child .midcol, .commentTop, .post-actions, .post-toolbar, .reply-button, .share-button, .user-signature, .signature"
PRODUCT_REMOVE = "nav[aria-label='breadcrumb'], nav[aria-label='Breadcrumb'], .breadcrumb, .breadcrumbs, .related-products, .recommended-products, .recently-viewed, .also-bought, .cross-sells, .upsells, #recently-viewed, .newsletter-popup, .newsletter-signup, .popup-overlay, #reviews, #customer-reviews, .reviews-section, .customer-reviews, [class*='reviews'], [class*='review-'], [class*='-review'], [id*='reviews'], [class*='rating'], [class*='ratings'], [class*='questions'], [class*='faq'], [id*='questions'], [id*='faq'], [class*='newsletter'], [class*='email-signup'], [class*='signup'], [class*='recently-viewed'], [class*='recommend'], [class*='related-'], [class*='sponsored'], [class*='a-carousel'], [class*='similarities'], [class*='merch-module'], [class*='vi-ilComp'], [class*='similar-'], [class*='also-viewed'], [class*='also-bought'], [class*='people-also'], [class*='you-may-also']"
DOCS_REMOVE = "div.sphinxsidebar, div.related, a.headerlink, #docs-sidebar, #docs-sidebar-popout, #docs-bottom-navigation, [role='complementary'], nav.browse-horizontal, .rst-other-versions, nav.wy-nav-side, .sidebar, .sidebar-elems, .sidebar-crate, a.src, .left-sidebar, .reference-toc, .document-toc, .bc-table, div.navheader, div.navfooter, nav.toc, .nav-sidebar, .docs-sidebar, .page-nav, .breadcrumb"

PROFILES = {
    "article": Profile(aggregate=True),
    "forum": Profile(
        content=("div[itemscope][itemtype='http://schema.org/DiscussionForumPosting']", "#mainbar", "div.block--messages", "ol.messageList", "div.cTopic", "table.comment-tree", "#page-body", "#postContent", "ul#commentlisting", "div.commentarea", ".thread-content", ".topic-body", ".post-container", "[data-controller='topic']", "#posts", "[role='main']"),
        keep_tags=("form",), remove=FORUM_REMOVE, comments_are_content=True,
    ),
    "product": Profile(
        content=("[itemtype*='schema.org/Product']", "[itemtype*='schema.org/SoftwareApplication']", ".product-page", ".product-detail", ".product-description", ".product-content", ".product-info", ".pdp-main", ".pdp-content", "#product-description", "#productDescription", "#descriptionAndDetails", ".item-description", "#item-description", "[itemprop='description']", ".game_description_snippet", ".game_area_description", "#game_area_description", "#desc_ifr", "#viTabs_0_is", ".x-item-description", "[class*='buy-box-product-description']", ".product__description", ".product-single__description", ".prose", ".rich-text", ".rte", "[role='main']", "main"),
        remove=PRODUCT_REMOVE, aggregate=True,
    ),
    "collection": Profile(),
    "listing": Profile(repeated=True),
    "documentation": Profile(
        content=("div.body", "main#main-content > article", "#docContent", "#main", "article.Doc", ".td-content", "article.main-page-content", "#mw-content-text", ".mw-parser-output", "#content-wrapper", "[role='main']", "article[role='main']", ".markdown", ".docs-content", ".guide-body", ".wiki-content", ".api-reference", ".markdown-body"),
        remove=DOCS_REMOVE,
    ),
    "service": Profile(aggregate=True),
}

CLEAN = frozenset("aside embed footer form head iframe menu object script applet audio canvas figure map picture svg video area blink button datalist dialog frame frameset fieldset link input ins label legend marquee math menuitem nav noscript optgroup option output param progress rp rt rtc select source style track textarea time use".split())
STRIP = frozenset("abbr acronym address bdi bdo big cite data dfn font hgroup img ins mark meta ruby small template tbody tfoot thead".split())
EMPTY = frozenset("article b blockquote dd div dt em h1 h2 h3 h4 h5 h6 i li main p pre q section span strong".split())
OVERLAYS = ".modal-dialog, .modal-content, .modal-backdrop, .modal-overlay, [class~='modal'], [role='dialog'], [id*='gdpr'], [class*='gdpr'], [id*='consent'], [class*='consent'], [class*='cookie-banner'], [id*='cookie-banner'], [class*='cookiebanner'], [id*='cookiebanner']"
NEVER = frozenset("nav aside script style noscript iframe svg ins".split())
HTML_TAGS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 blockquote pre code strong em b i a ul ol li dl dt dd table thead tbody tfoot tr td th caption colgroup col".split())
TABLE_TAGS = frozenset("table thead tbody tfoot tr td th caption colgroup col".split())
SHARE_PLUGINS = "[class*='dpsp-'], [class*='wabtn'], [class*='addtoany'], [class*='shareaholic'], [class*='share-wrapper'], [class*='social-share'], [class*='share-buttons'], [id*='share-buttons'], [class*='post-share'], [class*='entry-share'], [class*='shareModal'], [class*='ShareModal']"
BOILER_CHILD = "aside, nav, [class*='sidebar'], [class*='social'], [class*='share-'], [class*='-share'], [class*='author-'], [class*='sticky-'], [class*='toc-'], [class*='-toc'], [class*='related-'], [class*='widget']"
NESTED = "[class*='content_main'], [class*='content-main'], [class*='article-content'], [class*='article_content'], [class*='post-content'], [class*='post_content'], [class*='story-content'], [itemprop='articleBody'], [class*='blogInner__content'], [class*='blog-content'], [class*='blog_content'], [class*='blogContent'], [class*='entry-content']"
ARTICLES = "article, [role='article'], .article, .post, .entry"
MAINS = "main, [role='main'], #main, .main, #content, .content"
SPLIT_BODIES = ("article__body", "body__container", "entry-content", "storybodycompanioncolumn")
COMMENT_IDS = ("comments", "comment-section", "disqus_thread", "respond", "discussion")
COMMENT_CLASSES = ("comments", "comment-list", "respond", "discussion", "disqus", "fb-comments")
DATE_PLACES = ("[class*='publish-date']", "[class*='date-publish']", "[class*='post-date']", "[class*='entry-date']", "[class*='article-date']", "[itemprop='datePublished']", "[itemprop='dateCreated']")
LICENSE_PLACES = ("footer", ".footer", "#footer", "[class*='license']", "[class*='copyright']")

META = {
    "author": ("author", "article:author", "dc.creator", "dc.contributor", "byl", "sailthru.author", "parsely-author",),
    "title": ("og:title", "twitter:title", "dc.title", "sailthru.title", "parsely-title", "title",),
    "description": ("description", "og:description", "twitter:description", "dc.description", "excerpt",),
    "sitename": ("og:site_name", "application-name", "publisher", "dc.publisher", "twitter:site",),
    "url": ("og:url", "twitter:url",),
    "image": ("og:image", "twitter:image", "twitter:image:src", "thumbnail",),
    "date": ("article:published_time", "article:modified_time", "og:article:published_time", "article:published", "article.published", "article:created", "article.created", "date", "dc.date", "dc.date.issued", "dcterms.date", "dcterms.created", "datepublished", "datemodified", "og:updated_time", "sailthru.date", "parsely-pub-date", "datelastpubbed", "pubdate", "publish_date", "publishdate", "timestamp", "pdate", "cxenseparse:recs:publishtime",),
    "tags": ("article:tag", "keywords", "parsely-tags", "sailthru.tags",),
    "categories": ("article:section", "category", "parsely-section",),
    "og_type": ("og:type",),
    "language": ("og:locale", "language", "dc.language", "content-language",),
    "license": ("dc.rights", "dcterms.license", "dc.license",),
}
META_FIELD = {name: field for field, names in META.items() for name in names}

PRODUCT_GRID = ("product-grid", "product-list", "product-listing", "products-grid", "product-card", "product-tile", "collection-products", "search-results-products")
CART = ("add-to-cart", "add_to_cart", "addtocart", "add-to-bag", "buy-now", "buynow")
CART_TEXT = ("add to cart", "add to bag", "buy now")
DOCS_NAV = ("docs-sidebar", "doc-sidebar", "docs-nav", "doc-nav", "docsidebar", "docnav", "sidebar-docs", "api-reference", "apireference", "table-of-contents", "tableofcontents", "wiki-body", "wikibody", "mw-content")
PAGINATION = ("pagination", "pager", "paginator", "page-numbers", "page-nav")
PRODUCT_ITEM = ("product-card", "product-tile", "product-item", "product-block", "productcard", "producttile", "productitem", "product_card", "product_tile", "product_item")
