"""The DataFrame API: one Arrow stage that parses each page once; works on batches and streams."""

from __future__ import annotations

import codecs
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import classic as K
from . import metadata as M
from . import page as X
from .dom import parse
from .features import features

S, D, B = T.StringType(), T.DoubleType(), T.BooleanType()
IMAGE = T.StructType([T.StructField(k, B if k == "is_hero" else S) for k in ("src", "filename", "alt", "caption", "is_hero")])
METADATA = T.StructType([T.StructField(k, T.TimestampType() if k == "date" else T.ArrayType(S) if k in ("categories", "tags") else S) for k in "title author url hostname description sitename date categories tags id fingerprint license language image page_type".split()])
RESULT = [T.StructField(k, S) for k in ("content_text", "content_html", "content_markdown", "comments_text", "comments_html")] + [T.StructField("images", T.ArrayType(IMAGE)), T.StructField("metadata", METADATA), T.StructField("classification_confidence", D), T.StructField("extraction_quality", D), T.StructField("warnings", T.ArrayType(S))]
SIGNALS = T.StructType([T.StructField(k, t) for k, t in (("og_type", S), ("ld_types", T.ArrayType(S)), ("has_aggregate_offer", B), ("has_product_grid", B), ("has_add_to_cart", B), ("product_element_count", T.LongType()), ("has_pagination", B), ("code_block_count", T.LongType()), ("has_docs_nav", B), ("link_ratio", D), ("paragraph_word_count", T.LongType()))])
NODE = [T.StructField(k, t) for k, t in (("node", T.IntegerType()), ("parent", T.IntegerType()), ("depth", T.IntegerType()), ("tag", S), ("class", S), ("node_id", S), ("text", S))]

TASK_BYTES = 1 << 22  # of html in a task

CHARSET = re.compile(r"""(?i)<meta[^>]+charset\s*=\s*["']?([^"'\s>]+)""")
CONTENT_TYPE = re.compile(r"""(?i)<meta[^>]+http-equiv\s*=\s*["']?content-type["']?[^>]+content\s*=\s*["']?[^"'>]*;\s*charset\s*=\s*([^"'\s>]+)""")
#: Labels that mean another encoding on the web than in Python; all others go by Python's own aliases
LABELS = {
    **dict.fromkeys(("ascii", "us-ascii", "ansi_x3.4-1968", "iso-8859-1", "iso8859-1", "iso88591", "iso_8859-1", "iso-ir-100", "l1", "latin1", "latin-1", "cp819", "ibm819", "csisolatin1", "cp1252", "windows-1252", "x-cp1252"), "windows-1252"),
    **dict.fromkeys(("iso-8859-9", "iso8859-9", "latin5", "l5", "windows-1254", "cp1254"), "windows-1254"),
    **dict.fromkeys(("tis-620", "iso-8859-11", "windows-874", "dos-874"), "windows-874"),
    **dict.fromkeys(("gb2312", "gbk", "gb_2312-80", "chinese", "csgb2312", "x-gbk", "iso-ir-58"), "gb18030"),
    **dict.fromkeys(("euc-kr", "ks_c_5601-1987", "korean", "ksc5601", "csksc56011987", "windows-949"), "cp949"),
    **dict.fromkeys(("shift_jis", "sjis", "x-sjis", "ms_kanji", "shift-jis", "windows-31j", "csshiftjis"), "cp932"),
    **dict.fromkeys(("big5", "big5-hkscs", "cn-big5", "x-x-big5", "csbig5"), "big5hkscs"),
    **dict.fromkeys(("x-user-defined", "macintosh", "mac", "x-mac-roman"), "mac_roman"),
    **dict.fromkeys(("unicode", "utf-16", "utf-16le", "ucs-2", "csunicode", "iso-10646-ucs-2"), "utf-16-le"),
    **dict.fromkeys(("unicode-1-1-utf-8", "x-unicode20utf8", "utf8", "utf-8"), "utf-8"),
}
#: All 256 bytes: windows-1252, with control characters where it has none
LATIN = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(256))


def charset(head: bytes) -> str:
    """The encoding that a page declares in its first 1024 bytes: by a charset attribute or, if that label is unknown, by a content type. UTF-8 without one."""
    text = head[:1024].decode("utf-8", "replace")
    for pattern in (CHARSET, CONTENT_TYPE):
        if m := pattern.search(text):
            label = m[1].strip().lower()
            try:
                return LABELS.get(label) or codecs.lookup(label).name
            except (LookupError, ValueError):
                continue
    return "utf-8"


def decode(body: bytes) -> str:
    """Text of undecoded bytes: by a byte-order mark, else as declared; never fails."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    name = charset(body)
    if name == "windows-1252":
        return codecs.charmap_decode(body, "replace", LATIN)[0]
    try:
        return body.decode(name, "replace")
    except (LookupError, UnicodeError):  # no text encoding
        return body.decode("utf-8", "replace")


def _workers_import(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def _arrow(t) -> pa.DataType:
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC")}[t.simpleString()]


def dealt(df: DataFrame, small: bool | None = None, html: str | Column = "html") -> DataFrame:
    """df in tasks of at most 4 MB of html (a column or the expression of one), three a core at least. A file of one row group is one task, however large, and files say little of what their rows cost, so bytes are summed up by partition first; what is even enough stays where it is. Say whether df is small where the plan has shuffles, as the sums would run them: it is dealt to three tasks a core then, or left."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if small is None and not df.isStreaming:
        sizes = df.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length(html)).alias("n"))
        total, most = sizes.agg(F.sum("n"), F.max("n")).first()
        tasks = max(3 * cores, -(-(total or 0) // TASK_BYTES))
        return df if (most or 0) * tasks <= 3 * (total or 0) else df.repartition(tasks)
    return df.repartition(3 * cores) if small else df


def _map(df: DataFrame, html: str, url: str | None, more: list[T.StructField], record, kind: str | None = None, small: bool | None = None) -> DataFrame:
    """df without its html column, with the fields that record(html, url) or, with a column kind, record(html, url, kind) gives (a list of rows). Pages cost far more to parse than to move: a table of fewer partitions than cores is dealt out anew."""
    _workers_import(df.sparkSession)
    keep = [c for c in df.columns if c not in {html, *(f.name for f in more)}]
    df = dealt(df, small, html)
    schema = T.StructType([*(df.schema[c] for c in keep), *more])
    types = [_arrow(f.dataType) for f in more]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):  # pages are large: small output batches
                part = batch.slice(k, 200)
                pages = part.column(html).to_pylist()
                urls = part.column(url).to_pylist() if url else [None] * len(pages)
                kinds = [(k,) for k in part.column(kind).to_pylist()] if kind else [()] * len(pages)
                take, rows = [], []
                for i, (p, u, k) in enumerate(zip(pages, urls, kinds, strict=True)):
                    got = record(decode(p) if isinstance(p, bytes) else p or "", u, *k)
                    take += [i] * len(got)
                    rows += got
                kept = part.select(keep).take(pa.array(take, pa.int64())) if keep else None
                yield pa.RecordBatch.from_arrays([*(kept.columns if keep else ()), *(pa.array([r[f.name] for r in rows], t) for f, t in zip(more, types, strict=True))], names=[*keep, *(f.name for f in more)])

    return df.mapInArrow(run, schema)


def record_of(page: str | bytes | None, url: str | None, o: X.Options) -> dict:
    """The record of a page; one that raises has a warning and an empty text."""
    try:
        return X.extract(decode(page) if isinstance(page, bytes) else page or "", o.with_(url=o.url or url))
    except Exception as e:  # noqa: BLE001  a bad page must not fail the job
        meta = dict.fromkeys(METADATA.names) | {"categories": [], "tags": []}
        return dict(X.EMPTY, metadata=meta, warnings=[f"Content extraction failed: {type(e).__name__}: {e}"[:300]])


def extract(df: DataFrame, options: X.Options | None = None, html: str = "html", url: str | None = "url", page_type: str | None = None) -> DataFrame:
    """Extract every page of df; html is a string or undecoded binary column. The page's url counts unless options.url is set; page_type names a column of page types found before (see page_types.vote; null: found here). A page that raises gives a warning and an empty text. Columns of df that have the name of a result are replaced."""
    o = options or X.Options()
    if o.page_type:
        X.V.page_type(o.page_type)  # an unknown name is an error at once, not one of every page

    def record(page, own, kind=None):
        return [record_of(page, own, o.with_(page_type=kind or o.page_type))]

    return _map(df, html, url if url in df.columns else None, RESULT, record, page_type)


CLASSIC = [T.StructField("content_text", S), T.StructField("content_html", S), T.StructField("comments_text", S), T.StructField("used_recovery", B)]


def classic(df: DataFrame, options: X.Options | None = None, html: str = "html") -> DataFrame:
    """Every page of df by the classic way of extraction (see operators.classic)."""
    o = options or X.Options()
    return _map(df, html, None, CLASSIC, lambda page, _: [K.extract(page, o)])


def quality_features(df: DataFrame, options: X.Options | None = None, html: str = "html", url: str | None = "url") -> DataFrame:
    """The numbers of classic.QUALITY_FEATURES for the extraction of every page, to train a quality score of one's own on."""
    o = options or X.Options()

    def record(page, own):
        r = record_of(page, own, o)
        return [{"quality_features": K.quality_features(r["content_text"], r["content_html"], page, r["metadata"]["page_type"] or "article")}]

    return _map(df, html, url if url in df.columns else None, [T.StructField("quality_features", T.ArrayType(D))], record)


def html_signals(df: DataFrame, html: str = "html", url: str | None = "url") -> DataFrame:
    """Signals of the page type, and the type they and the URL give."""

    def record(page, own):
        doc = parse(page)
        body = next(n for n in doc.elements() if n.tag == "body")
        og = next((m.get("content") for m in doc.select("meta[property='og:type']")), None)
        s = M.signals(doc, body, og)
        return [{"signals": s, "page_type": M.refine(X.V.url_type(own), s)}]

    return _map(df, html, url if url in df.columns else None, [T.StructField("signals", SIGNALS), T.StructField("page_type", S)], record)


def ml_features(df: DataFrame, html: str = "html", url: str | None = "url") -> DataFrame:
    """The feature vector of every page (see features.NAMES), for a page-type model of one's own."""

    def record(page, own):
        doc = parse(page)
        body = next(n for n in doc.elements() if n.tag == "body")
        og = next((m.get("content") for m in doc.select("meta[property='og:type']")), None)
        return [{"features": features(doc, body, og, own)}]

    return _map(df, html, url if url in df.columns else None, [T.StructField("features", T.ArrayType(D))], record)


def node_rows(page: str | None) -> list[dict]:
    out, number = [], {}
    for n in parse(page or "").elements():
        number[id(n)] = len(out)
        out.append({"node": len(out), "parent": number.get(id(n.up)), "depth": sum(1 for _ in n.above()), "tag": n.tag, "class": n.get("class") or None, "node_id": n.get("id") or None, "text": "".join(k.data for k in n.kids if not k.tag)})
    return out


def html_nodes(df: DataFrame, html: str = "html") -> DataFrame:
    """A row per element, for relational queries over document trees. Columns of df that have the name of a result are replaced."""
    return _map(df, html, None, NODE, lambda page, _: node_rows(page))


def values_map(df: DataFrame, column: str, out: str, function) -> DataFrame:
    """df with a string column out = function(value of column), for functions of a value that need a tree or a resolver."""
    return _map(df.withColumn("__value", df[column]), "__value", None, [T.StructField(out, S)], lambda x, _: [{out: function(x)}])


#: how a column's name of an alignment pads its cells and rules its header, w wide
ALIGNED = {
    "left": (str.ljust, lambda w: ":" + "-" * (w - 1) + ":"),
    "center": (lambda x, w: " " * ((w - len(x)) // 2) + x + " " * (w - len(x) - (w - len(x)) // 2), lambda w: ":" + "-" * (w - 2) + ":"),
    "right": (str.rjust, lambda w: "-" * (w - 1) + ":"),
    "": (str.ljust, lambda w: " " + "-" * w + " "),
}


def table_markdown(html: str) -> str:
    """The tables of html as one pipe table: header rows, then the rest. Columns are as wide as their longest cell in bytes, three at least; the first align attribute of a column counts, in a table without header only those of its first row or later ones where it has none."""
    doc = parse(html)
    heads = [tr.select("th") for tr in doc.select("thead tr")]
    rows = [r for r in heads if r] + [r for tr in doc.select("tbody tr") if (r := tr.select("td, th"))]
    if not rows:
        return ""
    known = lambda c: a if (a := c.get("align").lower()) in ALIGNED else ""
    texts = [[c.text().strip() for c in r] for r in rows]
    n = max(map(len, rows))
    align = [next((a for r in rows if i < len(r) and (a := known(r[i]))), "") for i in range(n)]
    width = [max(3, *(X.V.size(t[i]) for t in texts if i < len(t))) for i in range(n)]
    lines = ["|" + "".join(f" {ALIGNED[a][0](t[i] if i < len(t) else '', w)} |" for i, (a, w) in enumerate(zip(align, width, strict=True))) for t in texts]
    return "\n".join([lines[0], "|" + "".join(ALIGNED[a][1](w) + "|" for a, w in zip(align, width, strict=True)), *lines[1:]]) + "\n"


def html_table_to_markdown(df: DataFrame, column: str, out: str = "markdown") -> DataFrame:
    return values_map(df, column, out, table_markdown)


URL_CHECK = T.StructType([T.StructField("url", S), T.StructField("valid", B)])


def resolve_urls(df: DataFrame, column: str, base: str) -> DataFrame:
    """df with absolute_url (the URL of column joined to that of base) and url_check (the resolved URL, and whether it is absolute)."""

    def record(x, own):
        x = x.strip()
        return [{"absolute_url": X.V.absolute(x, own), "url_check": {"url": X.V.absolute(x, own), "valid": X.V.is_absolute(X.V.absolute(x, own))}}]

    return _map(df.withColumn("__value", df[column]), "__value", base, [T.StructField("absolute_url", S), T.StructField("url_check", URL_CHECK)], record)


