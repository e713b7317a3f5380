"""spark-submit entry: extract a folder of HTML files, or one page from standard input.

python -m sievemill.cli markdown IN OUT      Markdown files with front matter, and counts
python -m sievemill.cli json IN OUT          JSON lines
python -m sievemill.cli stdin [--url URL] [--page-type TYPE] [--markdown] [--hybrid]   one JSON line; --hybrid adds the HTML of the content
"""

from __future__ import annotations

import argparse
import json
import sys

from .operators.values import page_type


def one_page(html: bytes, url: str | None, page_type: str | None, markdown: bool, hybrid: bool = False) -> str:
    """The JSON line of a page; null fields and an empty text for one that raises."""
    from .operators.page import Options, extract
    from .operators.stage import decode

    try:
        r = extract(decode(html), Options(url=url, page_type=page_type, output_markdown=markdown, include_links=markdown))
    except Exception:  # noqa: BLE001  the caller gets a line for every page
        return json.dumps({"title": None, "author": None, "date": None, "main_content": "", "confidence": 0.0})
    m = r["metadata"]
    line = {"title": m["title"], "author": m["author"], "date": m["date"].isoformat() if m["date"] else None, "main_content": r["content_text"]}
    line |= {k: v for k, v in (("page_type", m["page_type"]), ("classification_confidence", r["classification_confidence"])) if v is not None}
    line["confidence"] = r["extraction_quality"]
    line |= {k: r[k] for k, wanted in (("content_html", hybrid), ("content_markdown", markdown)) if wanted and r[k] is not None}
    return json.dumps(line, ensure_ascii=False)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sievemill")
    todo = p.add_subparsers(dest="do", required=True)
    for name in ("markdown", "json"):
        s = todo.add_parser(name)
        s.add_argument("folder")
        s.add_argument("out")
    s = todo.add_parser("stdin")
    s.add_argument("--url")
    s.add_argument("--page-type", type=page_type, help="article, forum, product, collection or category, listing, documentation or docs, service")
    s.add_argument("--markdown", action="store_true")
    s.add_argument("--hybrid", action="store_true")
    a = p.parse_args(args)
    if a.do == "stdin":
        print(one_page(sys.stdin.buffer.read(), a.url, a.page_type, a.markdown, a.hybrid))
        return
    from pyspark.sql import SparkSession

    from .operators.stage import extract
    from .sources import html_files

    spark = SparkSession.builder.appName("sievemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.do == "markdown":
        print(json.dumps(html_files.markdown_files(spark, a.folder, a.out)))
    else:
        html_files.json_lines(extract(html_files.read_html(spark, a.folder))).write.mode("overwrite").text(a.out)


if __name__ == "__main__":
    main()
