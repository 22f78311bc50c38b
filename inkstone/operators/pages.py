"""Web pages: blocks, numbered headings, Markdown, links, preview text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.numbering import outline_format
from inkstone.functions.text import html_unescape
from inkstone.operators.sequences import outline_numbers
from inkstone.operators.tables import ordered

#: Elements that are dropped whole, and those that begin a block.
DROPPED = ("head", "script", "style", "nav", "footer")
BLOCKS = "<(h[1-9]|p|li|div|article|ul|ol|table|tr|blockquote|pre)( [^>]*)?>"


def content(html: Column) -> Column:
    html = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in DROPPED:
        html = F.regexp_replace(html, f"(?s)<{tag}( [^>]*)?>.*?</{tag}>", "")
    return F.regexp_replace(html, '(?s)<div class="ad[^>]*>.*?</div>', "")


def visible_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(html_unescape(F.regexp_replace(html, "<[^>]*>", " ")), "\\s+", " "))


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind, text of every non-empty block."""
    marked = F.regexp_replace(content(F.col("html")), BLOCKS, "\u001e<$1>")
    split = pages.select("page_id", F.posexplode(F.split(marked, "\u001e")).alias("pos", "block"))
    return split.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("block", "^<([a-z0-9]+)", 1).alias("kind"), visible_text(F.col("block")).alias("text")).where("text <> ''")


def page_markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown: headings with outline numbers, list items, paragraphs."""
    blocks = page_blocks(pages).withColumn("level", F.when(F.col("kind").rlike("^h[1-9]$"), F.substring("kind", 2, 1).cast("long")))
    numbered = outline_numbers(blocks.withColumn("level", F.coalesce("level", F.lit(9))), ["page_id"], "pos", "level")
    heading = F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), outline_format(F.col("level"), F.col("n")), F.lit(" "), F.col("text"))
    line = F.when(F.col("kind").rlike("^h[1-7]$"), heading).when(F.col("kind") == "li", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    return numbered.withColumn("line", line).groupBy("page_id").agg(ordered(["pos"], "line", "\n\n").alias("markdown"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url, anchor of every link."""
    found = F.expr("regexp_extract_all(html, '(?s)(<a [^>]*href=\"[^\"]*\"[^>]*>.*?</a>)', 1)")
    links = pages.select("page_id", F.posexplode(found).alias("pos", "link"))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("link", 'href="([^"]*)"', 1).alias("url"), visible_text(F.col("link")).alias("anchor"))


def page_preview(pages: DataFrame, chars: int = 160) -> DataFrame:
    """page_id, preview: the start of the visible text. A preview is short by definition."""
    return pages.select("page_id", F.substring(visible_text(content(F.col("html"))), 1, chars).alias("preview"))
