"""Queries over JSON-LD and tables that are made from given rows, with their DuckDB SQL: no Python worker in any plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonld, tables
from ..operators.stage import dealt
from .catalog import STRIP


def json_ld_harvest(spark, d):
    """Every turn of every conversation as the JSON-LD of a page: what a site, its articles (one inside another) and their persons say."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    person = F.struct(F.lit("Person").alias("@type"), F.concat(F.lit(" Writer "), F.col("conv_id")).alias("name"))
    composed = F.struct(F.lit("Author").alias("@type"), F.col("role").alias("givenName"), F.col("turn").cast("string").alias("familyName"))
    inner = F.struct(F.array(F.lit("Thing"), F.lit("NewsArticle")).alias("@type"), F.array(F.col("text"), F.lit("x")).alias("headline"), F.lit("a, ,b").alias("keywords"), F.lit("2024-01-02").alias("datePublished"), composed.alias("author"))
    outer = F.struct(F.lit("WebPage").alias("@type"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit(" ")).alias("name"), F.when(F.col("turn") % 3 == 0, F.lit("someday")).otherwise(F.lit("2023-05-06T07:08:09Z")).alias("datePublished"), F.struct(F.concat(F.lit("u"), F.col("conv_id")).alias("url")).alias("image"), F.struct(F.lit("Publisher").alias("@type"), F.concat(F.col("role"), F.lit(" house")).alias("name")).alias("publisher"), F.struct(inner.alias("untyped")).alias("part"))
    graph = F.to_json(F.struct(F.struct(person.alias("list")).alias("@graph"), outer.alias("page")))
    blocks = F.array(F.lit("{not json"), graph)
    found = t.select("conv_id", "turn", blocks.alias("b")).select("conv_id", "turn", jsonld.harvest("b").alias("h"))
    return found.select("conv_id", "turn", *(F.col(f"h.{k}").alias(k) for k in ("author", "sitename", "title", "image")), F.array_join("h.categories", "|").alias("categories"), F.unix_timestamp(jsonld.first_date(F.col("h.date_text"))).alias("seconds"))


def json_search(spark, d):
    """Texts of every turn found again under a key, in JSON within JSON."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    inner = F.to_json(F.array(F.struct(F.col("role").alias("articleBODY"), F.col("turn").alias("articlebody"))))
    json = F.to_json(F.struct(F.struct(F.col("text").alias("ArticleBody"), F.lit(5).alias("other")).alias("a"), inner.alias("b"), F.lit("no").alias("c")))
    found = t.select("conv_id", "turn", json.alias("j")).select("conv_id", "turn", jsonld.json_strings("j", "articleBody").alias("s"))
    return found.select("conv_id", "turn", F.array_join("s", "|").alias("found"))


def table_texts(spark, d):
    """Every event as a table with cells that span rows and columns, and one inside another."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.col("user_id").cast("string").alias("user"))
    html = F.concat(
        F.lit("<p>x<table><tr><th colspan=2>Event</th><th rowspan='3'>"), F.col("event_type"), F.lit("</th></tr><tr><td rowspan=2> user \n id </td><td colspan="), (F.col("event_id") % 3).cast("string"), F.lit(">"), F.col("user"),
        F.lit("</td></tr><tr><td></td></tr><tr><td> </td></tr><tr><td>a<table><tr><td>"), F.col("event_id").cast("string"), F.lit("</table></td></tr></table>"),
    )
    found = tables.with_table_texts(dealt(e, html=html).select("event_id", html.alias("html")))
    return found.select("event_id", F.size("tables").alias("tables"), F.array_join("tables", "\n\n").alias("text"))


QUERIES = {f.__name__: f for f in (json_ld_harvest, json_search, table_texts)}
ORACLES = {
    "json_ld_harvest": f"""SELECT conv_id, turn, 'Writer ' || conv_id AS author, trim(role || ' house') AS sitename, nullif({STRIP('text')}, '') AS title, 'u' || conv_id AS image, 'a|b' AS categories,
 CASE WHEN turn % 3 = 0 THEN epoch(TIMESTAMP '2024-01-02') ELSE epoch(TIMESTAMP '2023-05-06 07:08:09') END::BIGINT AS seconds FROM conversations""",
    "json_search": "SELECT conv_id, turn, concat_ws('|', text, role) AS found FROM conversations",
    "table_texts": """SELECT event_id, 2 AS tables, 'Event | Event | ' || event_type || chr(10) || 'user id | ' || user_id || CASE WHEN event_id % 3 = 2 THEN ' | ' || user_id ELSE ' | ' || event_type END || chr(10) || 'user id |  | ' || event_type
 || chr(10) || 'a' || event_id || ' | ' || event_id || CASE WHEN event_id % 3 = 2 THEN ' | ' || event_type ELSE '' END || chr(10) || event_id || chr(10) || chr(10) || event_id AS text FROM events""",
}
