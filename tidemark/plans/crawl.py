"""Named queries over pages: bodies by structure, list pages by selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structure
from ..functions.structure import ListRule
from ..sources.tables import table
from .registry import query

#: What the rules give for these pages, by patterns: an article's pieces of text are lines, a page's are words.
PAGE_SQL = r"""parts AS (SELECT page_id, html, list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>'), lambda x: trim(replace(replace(x, '&amp;', '&'), '&quot;', '"'))), lambda x: x <> '') AS pieces,
  list_filter(list_transform(regexp_split_to_array(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>'), lambda x: trim(replace(replace(replace(replace(x, '&amp;', '&'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'))), lambda x: x <> '') AS everything FROM pages),
told AS (SELECT page_id, html, array_to_string(pieces, chr(10)) AS body, len(regexp_replace(array_to_string(pieces, ''), '\s', '', 'g')) AS size, regexp_replace(array_to_string(everything, ' '), '\s+', ' ', 'g') AS whole FROM parts)"""


@query(f"WITH {PAGE_SQL} SELECT page_id, CASE WHEN size >= 100 THEN 'place: article' WHEN length(whole) >= 100 THEN 'text' ELSE 'none' END AS method, CASE WHEN size >= 100 THEN body WHEN length(whole) >= 100 THEN whole ELSE '' END AS content FROM told")
def page_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each page's densest block, else all its text."""
    pages = table(spark, d, "pages").select("page_id", structure.article_of(F.col("html")).alias("found"))
    return pages.select("page_id", "found.method", "found.content")


@query(f"""WITH {PAGE_SQL}, kinds AS (SELECT *, page_id % 4 AS kind FROM told)
SELECT page_id, CASE WHEN kind = 0 AND size >= 100 AND length(body) >= 500 THEN 'source: div[class*="story_main"]' WHEN kind = 1 AND size >= 100 AND length(body) >= 500 THEN 'source: div[class*="rm"]'
  WHEN kind < 2 AND size >= 100 THEN 'place: div[class*="text"]' WHEN kind = 2 AND size >= 100 THEN 'block' WHEN length(whole) >= 100 THEN 'text' ELSE 'none' END AS method,
  CASE WHEN kind < 3 AND size >= 100 THEN body WHEN length(whole) >= 100 THEN whole ELSE '' END AS content FROM kinds""")
def page_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The same pages with their articles in other elements, by their sources' own patterns: each step of the cascade is the last for some."""
    kind = F.col("page_id") % 4
    tag = F.when(kind == 0, '<div class="story_main text">').when(kind == 1, '<div class="rm text">').when(kind == 2, '<div class="story">').otherwise("<b>")
    html = F.replace(F.replace("html", F.lit("<article>"), tag), F.lit("</article>"), F.when(kind == 3, "</b>").otherwise("</div>"))
    pattern = F.when(kind == 0, '<div class="story_main text"[^>]*>(.*?)</div>').when(kind == 1, '<div class="elsewhere"[^>]*>(.*?)</div>')
    pages = table(spark, d, "pages").select("page_id", structure.article_of(html, pattern).alias("found"))
    return pages.select("page_id", "found.method", "found.content")


def _rules(*rules: ListRule) -> Column:
    kind = F.col("page_id") % (len(rules) + 1)
    chosen = F.when(kind == 0, structure.rule(rules[0]))
    for i, r in enumerate(rules[1:], 1):
        chosen = chosen.when(kind == i, structure.rule(r))
    return chosen


@query(r"""WITH p AS (SELECT *, page_id % 4 AS kind FROM pages),
links AS (SELECT page_id, kind, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS item, unnest(range(0, len(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')))) AS nth FROM p WHERE kind <> 1),
texts AS (SELECT page_id, kind, nth, trim(replace(regexp_extract(item, '>([^<]+)</a>', 1), '&amp;', '&')) AS title, CASE WHEN kind = 2 THEN regexp_extract(item, 'href="([^"]*)"', 1) ELSE '' END AS publish_time FROM links WHERE kind IN (0, 2)),
kept AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1 AS place, title, publish_time, '' AS content FROM texts WHERE length(title) > 2)
SELECT page_id, CAST(place AS INTEGER) AS place, title, publish_time, content FROM kept
UNION ALL SELECT page_id, 0, trim(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '&quot;', '"')), '', '' FROM p WHERE kind = 1 AND length(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))) > 2""")
def list_rows_by_selectors(spark: SparkSession, d: str) -> DataFrame:
    """Items of each page by its source's rule: links of its menu, its article by a spare title, dates from an attribute; every fourth source has no rule."""
    by_kind = _rules(
        ListRule(item="nav li", title="a", content="", date=""), ListRule(item="body > article", title="h2.title, h2 > a", spare_title="h1", content="div.none", date="span"), ListRule(item="nav > ul > li", title='a[href^="/"]', content="", date="a", date_attribute="href")
    )
    pages = table(spark, d, "pages").select("page_id", "html", by_kind.alias("rule"))
    return structure.listed(pages, "html", "rule").drop("subtitle")


@query("""SELECT CAST(o_orderkey // 64 AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) - 1 AS INTEGER) AS place, CASE WHEN o_orderkey // 64 % 2 = 0 THEN o_orderpriority ELSE '[' || o_orderpriority || '] order ' || CAST(o_orderkey AS VARCHAR) END AS title,
  strftime(o_orderdate, '%Y/%m/%d') AS publish_time, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'The report of customer ' || CAST(o_custkey AS VARCHAR) || ' and others.' END AS content FROM orders""")
def list_rows_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """List pages made of 64 orders' keys each: titles with a date in them that goes, bracketed names, contents of several elements or none."""
    order = F.col("o_orderkey")
    text = F.when(order % 5 == 0, "").otherwise(F.concat(F.lit('<div class="news txt"><b>The report</b> of customer <i>'), F.col("o_custkey").cast("string"), F.lit("</i><script>var x;</script> and others.</div>")))
    title = F.concat(F.lit("["), F.col("o_orderpriority"), F.lit("] order "), order.cast("string"))
    item = F.concat(F.lit("<li class=row><div class=tit><a class='link blue' href=#>"), title, F.lit(" <span>"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("</span></a></div>"), text)
    pages = table(spark, d, "orders").select(F.floor(order / 64).alias("page_id"), order.alias("at"), item.alias("item")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("held"))
    html = F.concat(F.lit("<html><body><ul id='list'>"), F.array_join(F.transform("held", lambda x: x["item"]), ""), F.lit("</ul>"))
    shared = {"item": "ul#list > li.row", "title": "div.tit a.blue", "content": "div.news.txt", "date": "div.tit span"}
    rule = F.when(F.col("page_id") % 2 == 0, structure.rule(ListRule(**shared, product_only=True))).otherwise(structure.rule(ListRule(**shared)))
    return structure.listed(pages.select("page_id", html.alias("html"), rule.alias("rule")), "html", "rule").drop("subtitle")
