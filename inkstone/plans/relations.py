"""Joins, windows, folds and aggregations of document structure, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.operators import joins as J
from inkstone.operators import sequences as Q

LEVEL = "CAST(floor(value) AS BIGINT) % 9 + 1"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores: few small rows, each of which costs far more to pack and decode than its bytes tell."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def headings(spark: SparkSession, d: str) -> DataFrame:
    """events as headings: a level from 1 to 9 for each, in the order of event_id within user_id."""
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.pmod(F.floor("value").cast("long"), F.lit(9)) + 1).alias("level"))


def dim_lookup(spark, d):
    """lineitem by the brand of its part; parts of a tenth of all keys are unknown, as lineitem's keys are shifted past part's end."""
    items = read(spark, d, "lineitem").withColumn("p_partkey", F.expr("l_partkey + l_linenumber * 40"))
    found = J.lookup(items, read(spark, d, "part"), ["p_partkey"], "p_brand", F.lit("default"), "style")
    return found.groupBy("style").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def two_key_numbering_lookup(spark, d):
    levels = spark.createDataFrame([(i, k, 10 * i + k) for i in range(3) for k in range(1, 8)], "num_id long, l_linenumber int, start long")
    found = J.lookup(read(spark, d, "lineitem").withColumn("num_id", F.pmod("l_suppkey", F.lit(4))), levels, ["num_id", "l_linenumber"], "start", F.lit(1).cast("long"))
    return found.groupBy("l_linenumber", "start").agg(F.count("*").alias("n"))


def asof_shape_at_position(spark, d):
    e = headings(spark, d)
    found = Q.asof_last(e, ["user_id"], "event_id", F.when(F.col("event_type") == "error", F.col("event_id")), "shape")
    return found.select("event_id", "user_id", "shape")


def offset_map(spark, d):
    e = headings(spark, d)
    found = Q.asof_last(e, ["user_id"], "event_id", F.when(F.col("event_type") == "error", F.col("event_id")), "origin")
    return found.where("origin is not null").select("event_id", (F.col("origin") * 10 + F.col("event_id") - F.col("origin")).alias("extracted"))


def interval_clip(spark, d):
    e = headings(spark, d).select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + F.col("level") * 40).alias("end"), "event_type")
    links = e.where("event_type = 'click'").select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return Q.clip(e.where("event_type = 'view'"), links, ["user_id"]).select("user_id", "start", "r_start", "clip_start", "clip_end")


def outline_counter(spark, d):
    return Q.outline_numbers(headings(spark, d), ["user_id"], "event_id", "level").select("event_id", "user_id", "level", "n")


def list_counter(spark, d):
    return Q.outline_numbers(headings(spark, d), ["user_id", "event_type"], "event_id", "level").select("event_id", "level", "n")


def auto_number_with_reset(spark, d):
    e = headings(spark, d)
    is_reset = F.col("event_type") == "error"
    return Q.numbers_with_reset(e, ["user_id"], "event_id", is_reset, F.col("level"), ~is_reset).select("event_id", "n")


def restart_per_section(spark, d):
    """Numbers of a user's events that begin anew in each section of 500; an error sets the next number."""
    e = headings(spark, d).withColumn("section", F.expr("event_id div 500"))
    is_reset = F.col("event_type") == "error"
    return Q.numbers_with_reset(e, ["user_id", "section"], "event_id", is_reset, F.col("level"), ~is_reset, first=F.lit(3)).select("event_id", "section", "n")


def parent_by_level(spark, d):
    e = headings(spark, d).withColumn("level", F.col("level") - 1)
    return Q.parent_by_level(e, ["user_id"], "event_id", "level", 8).select("event_id", "level", "parent")


def line_ranges(spark, d):
    c = read(spark, d, "conversations").withColumn("start", F.col("turn") * 10)
    total = F.max("start").over(Window.partitionBy("conv_id")) + F.length("text")
    return Q.ranges(c.withColumn("total", total), ["conv_id"], "turn", "start", F.col("total")).select("conv_id", "turn", "start", F.col("end").cast("long").alias("end"))



def page_break_fold(spark, d):
    e = headings(spark, d).withColumn("height", F.floor("value").cast("long"))
    return Q.page_breaks(e, ["user_id"], "event_id", "height", 250).select("user_id", "event_id", F.col("page"))


def pagination_rules(spark, d):
    from inkstone.operators.layout import paginate

    at = F.pmod(F.floor("value").cast("long") * 7, F.lit(300))
    e = headings(spark, d).select("user_id", "event_id", (F.col("event_type") == "error").alias("page_break"), at.alias("first"), (at + 5).alias("last"), (at + 9).alias("bottom"), F.lit(200).alias("content_height"))
    return paginate(e, ["user_id"], "event_id").select("user_id", "event_id", "page", F.coalesce("reason", F.lit("")).alias("reason"))


def positional_zip(spark, d):
    c = read(spark, d, "conversations")
    side = lambda role: c.where(F.col("role") == role).select("conv_id", F.col("turn").alias(f"{role}_turn"))
    return J.zip_ranked(side("user"), side("assistant"), ["conv_id"], "user_turn", "assistant_turn")


def caption_anti_join(spark, d):
    docs = read(spark, d, "documents")
    return J.without_texts(docs, docs.where("source = 'src0'"), "text").select("doc_id", "source")


def duplicate_text_anti_join(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    cells = read(spark, d, "benchmark").select(F.col("text").alias("line"))
    return J.without_texts(lines, cells, "line").groupBy("doc_id").agg(F.count("*").alias("lines"))


def run_semi_join(spark, d):
    labelled = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    return J.held(read(spark, d, "pages").select("page_id", "url"), labelled, ["page_id"])


def five_part_union(spark, d):
    """An order as a document: a header, its items as body, a footer, a footnote for each returned item, and an endnote."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("pos"), "o_orderstatus", "o_orderpriority")
    li = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))
    line = lambda df, *parts: df.select("k", "pos", F.concat(*parts).alias("line"))
    text, lit = lambda c: F.col(c).cast("string"), F.lit
    parts = [line(o, lit("# "), text("k")), line(li, lit("item "), text("pos")), line(o, text("o_orderstatus")), line(li.where("flag = 'R'"), lit("[^"), text("pos"), lit("]: back")), line(o, text("o_orderpriority"))]
    return J.assemble(parts, "k", "pos", "line")


def doc_info_summary(spark, d):
    docs = read(spark, d, "documents")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.size(F.split("text", "\n"))).alias("paragraphs"), F.sum("n_chars").alias("chars"))


def control_char_table(spark, d):
    codes = spark.range(0, 40).select(F.col("id").alias("code"))
    found = read(spark, d, "documents").agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("breaks")).withColumn("code", F.lit(10).cast("long"))
    kinds = codes.select("code", X.control_class(F.col("code")).alias("kind"), X.control_units(F.col("code")).alias("size"), X.control_name(F.col("code")).alias("name"))
    return J.lookup(kinds, found, ["code"], "breaks", F.lit(0).cast("long"), "uses")


def rules_once(spark, d):
    """Rules in a conversation's lines: none after another, after an empty line or at the top."""
    c = read(spark, d, "conversations").withColumn("line", F.when(F.pmod("turn", F.lit(3)) < 2, F.lit("---")).otherwise(F.col("text")))
    return J.without_double_rules(c, ["conv_id"], "turn", "line").select("conv_id", "turn", "line")


def natural_sections(spark, d):
    """Section names of a document in the order of their numbers."""
    names = read(spark, d, "part").select("p_brand", F.concat(F.lit("Contents/section"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("name"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(J.natural_order(F.col("name")))).cast("long")
    return names.select("p_brand", "name", place.alias("place"))


def caption_ids_anti_join(spark, d):
    """Parts no line item names; the ids 0 and 2^31 are nobody's."""
    used = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return J.without_ids(read(spark, d, "part").select("p_partkey", "p_name"), used, "p_partkey")


def column_groups(spark, d):
    from inkstone.operators.layout import column_groups as groups

    e = headings(spark, d).withColumn("top", F.floor("value").cast("long"))
    return groups(e, ["user_id"], "event_id", "top").select("event_id", "user_id", "group")


def column_assignment(spark, d):
    from inkstone.operators.layout import assign_columns

    e = headings(spark, d).withColumn("top", F.pmod(F.floor("value").cast("long"), F.lit(50))).withColumn("bottom", F.col("top") + 10)
    return assign_columns(e, ["user_id"], "event_id", 2)


def outline_sql(keys: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whens = " ".join(f"WHEN level = {k} THEN coalesce(max(CASE WHEN level < {k} THEN event_id END) {w}, -1)" for k in range(1, 8))
    return f"WITH e AS (SELECT *, {LEVEL} AS level FROM events), g AS (SELECT *, CASE {whens} END AS grp FROM e) SELECT event_id, {{cols}} level, CASE WHEN level <= 7 THEN CAST(row_number() OVER (PARTITION BY {keys}, level, grp ORDER BY event_id) AS BIGINT) ELSE 0 END AS n FROM g"


#: before, deepest and origin are the fold's state; a reason counts only on a page that holds something, which all but the first do.
PAGINATION = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS asked, (CAST(floor(value) AS BIGINT) * 7) % 300 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, CAST(1 AS BIGINT) AS page, '' AS reason, f + 5 AS before, f + 5 AS deepest, CAST(0 AS BIGINT) AS origin FROM e WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, page + CASE WHEN r = '' THEN 0 ELSE 1 END, r, f + 5 - o, CASE WHEN r = '' THEN greatest(deepest, f + 5 - o) ELSE greatest(0, f + 5 - o) END, o FROM
    (SELECT *, CASE WHEN r = 'reset' THEN f + 5 ELSE origin END AS o FROM
      (SELECT e.user_id, e.event_id, e.k, e.f, s.page, s.deepest, s.origin, CASE WHEN e.asked THEN 'explicit'
        WHEN (e.f - s.origin < 0.1 OR (s.before > 0.1 AND e.f - s.origin < s.before - 0.1)) AND (e.f - s.origin < 0.1 OR e.f - s.origin < 40) THEN 'reset'
        WHEN e.f + 9 - s.origin > 200 AND s.deepest > 0 THEN 'overflow' ELSE '' END AS r
       FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT user_id, event_id, page, reason FROM s"""


CONTROL_KIND = "CASE WHEN range IN (0, 10, 13, 24, 30, 31) THEN 'char' WHEN range IN (4, 5, 6, 7, 8, 9, 19, 20) THEN 'inline' ELSE 'extended' END"

#: a and b are the depths of the two columns, null for an empty one; the nearest depth above the block's top wins, then an empty column, then a new page.
COLUMNS = """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 50 AS top, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, CAST(1 AS BIGINT) AS page, CAST(0 AS BIGINT) AS c, top + 10 AS a, CAST(NULL AS BIGINT) AS b FROM e WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, page + CASE WHEN c = 2 THEN 1 ELSE 0 END, CASE WHEN c = 2 THEN 0 ELSE c END, CASE WHEN c IN (0, 2) THEN top + 10 ELSE a END, CASE WHEN c = 2 THEN NULL WHEN c = 1 THEN top + 10 ELSE b END FROM
    (SELECT e.user_id, e.event_id, e.k, e.top, s.page, s.a, s.b, CAST(CASE WHEN s.a <= e.top AND (s.b IS NULL OR s.b > e.top OR s.b <= s.a) THEN 0 WHEN s.b <= e.top THEN 1 WHEN s.a IS NULL THEN 0 WHEN s.b IS NULL THEN 1 ELSE 2 END AS BIGINT) AS c
     FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
SELECT user_id, event_id, page, c AS "column" FROM s"""


def catalog() -> dict:
    upto = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    parents = " ".join(f"WHEN level = {k} THEN max(CASE WHEN level = {k - 1} THEN event_id END) {upto}" for k in range(1, 9))
    ranges = f"SELECT user_id, event_type, event_id AS s, event_id + ({LEVEL}) * 40 AS e FROM events"
    return {
        "dim_lookup": (dim_lookup, "SELECT coalesce(p_brand, 'default') AS style, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN part ON l_partkey + l_linenumber * 40 = p_partkey GROUP BY 1"),
        "two_key_numbering_lookup": (two_key_numbering_lookup, "SELECT l_linenumber, CASE WHEN l_suppkey % 4 < 3 AND l_linenumber BETWEEN 1 AND 7 THEN 10 * (l_suppkey % 4) + l_linenumber ELSE 1 END AS start, count(*) AS n FROM lineitem GROUP BY 1, 2"),
        "asof_shape_at_position": (asof_shape_at_position, "SELECT e.event_id, e.user_id, s.event_id AS shape FROM events e ASOF LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'error') s ON e.user_id = s.user_id AND e.event_id >= s.event_id"),
        "offset_map": (offset_map, "SELECT e.event_id, s.event_id * 10 + e.event_id - s.event_id AS extracted FROM events e ASOF JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'error') s ON e.user_id = s.user_id AND e.event_id >= s.event_id"),
        "interval_clip": (interval_clip, f"WITH r AS ({ranges}) SELECT a.user_id, a.s AS start, b.s AS r_start, greatest(a.s, b.s) AS clip_start, least(a.e, b.e) AS clip_end FROM r a JOIN r b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'view' AND b.event_type = 'click'"),
        "outline_counter": (outline_counter, outline_sql("user_id").replace("{cols}", "user_id,")),
        "list_counter": (list_counter, outline_sql("user_id, event_type").replace("{cols}", "")),
        "auto_number_with_reset": (auto_number_with_reset, f"WITH e AS (SELECT *, {LEVEL} AS level, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) {upto} AS island FROM events), f AS (SELECT *, first_value(CASE WHEN event_type = 'error' THEN level END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS start, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS used FROM e) SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(coalesce(start, 1) + used - 1 AS BIGINT) END AS n FROM f"),
        "restart_per_section": (restart_per_section, f"WITH e AS (SELECT *, event_id // 500 AS section, {LEVEL} AS level FROM events), g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS island FROM e WINDOW w AS (PARTITION BY user_id, section ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), f AS (SELECT *, first_value(CASE WHEN event_type = 'error' THEN level END) OVER v AS start, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER v AS used FROM g WINDOW v AS (PARTITION BY user_id, section, island ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT event_id, section, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(coalesce(start, 3) + used - 1 AS BIGINT) END AS n FROM f"),
        "parent_by_level": (parent_by_level, f"WITH e AS (SELECT *, {LEVEL} - 1 AS level FROM events) SELECT event_id, level, CASE {parents} END AS parent FROM e"),
        "line_ranges": (line_ranges, "SELECT conv_id, turn, turn * 10 AS start, CAST(coalesce(lead(turn * 10) OVER (PARTITION BY conv_id ORDER BY turn), turn * 10 + length(text)) AS BIGINT) AS \"end\" FROM conversations"),
        "page_break_fold": (page_break_fold, "WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f AS (SELECT user_id, event_id, k, CAST(1 AS BIGINT) AS page, h AS used FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN f.used > 0 AND f.used + e.h > 250 THEN f.page + 1 ELSE f.page END, CASE WHEN f.used > 0 AND f.used + e.h > 250 THEN e.h ELSE f.used + e.h END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1) SELECT user_id, event_id, page FROM f"),
        "pagination_rules": (pagination_rules, PAGINATION),
        "positional_zip": (positional_zip, "WITH a AS (SELECT conv_id, turn AS user_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn AS assistant_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') SELECT conv_id, k, user_turn, assistant_turn FROM a FULL JOIN b USING (conv_id, k)"),
        "caption_anti_join": (caption_anti_join, "SELECT doc_id, source FROM documents WHERE trim(text) NOT IN (SELECT trim(text) FROM documents WHERE source = 'src0')"),
        "duplicate_text_anti_join": (duplicate_text_anti_join, "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, count(*) AS lines FROM l WHERE line <> '' AND line NOT IN (SELECT trim(text) FROM benchmark) GROUP BY 1"),
        "run_semi_join": (run_semi_join, "SELECT page_id, url FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
        "five_part_union": (five_part_union, "WITH li AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS pos, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), p AS (SELECT o_orderkey AS k, 0 AS part, 0 AS pos, '# ' || CAST(o_orderkey AS VARCHAR) AS line FROM orders UNION ALL SELECT k, 1, pos, 'item ' || CAST(pos AS VARCHAR) FROM li UNION ALL SELECT o_orderkey, 2, 0, o_orderstatus FROM orders UNION ALL SELECT k, 3, pos, '[^' || CAST(pos AS VARCHAR) || ']: back' FROM li WHERE flag = 'R' UNION ALL SELECT o_orderkey, 4, 0, o_orderpriority FROM orders) SELECT k, string_agg(line, chr(10) || chr(10) ORDER BY part, pos) AS text FROM p GROUP BY k"),
        "doc_info_summary": (doc_info_summary, "SELECT lang, source, count(*) AS docs, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS paragraphs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2"),
        "control_char_table": (control_char_table, "SELECT range AS code, " + CONTROL_KIND + " AS kind, CAST(CASE WHEN range > 31 OR " + CONTROL_KIND + " = 'char' THEN 1 ELSE 8 END AS BIGINT) AS size, CASE " + " ".join(f"WHEN range = {k} THEN '{v}'" for k, v in X.CONTROL_NAMES.items()) + " WHEN range <= 31 THEN 'RESERVED_' || CAST(range AS VARCHAR) ELSE 'UNKNOWN_' || CAST(range AS VARCHAR) END AS name, CASE WHEN range = 10 THEN (SELECT CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) FROM documents) ELSE 0 END AS uses FROM range(40)"),
        "rules_once": (rules_once, "WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN '---' ELSE text END AS line FROM conversations), b AS (SELECT *, lag(line) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM c) SELECT conv_id, turn, line FROM b WHERE NOT (starts_with(line, '---') AND (prev IS NULL OR starts_with(prev, '---') OR prev = ''))"),
        "natural_sections": (natural_sections, "SELECT p_brand, 'Contents/section' || CAST(p_partkey AS VARCHAR) || '.xml' AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part"),
        "caption_ids_anti_join": (caption_ids_anti_join, "SELECT p_partkey, p_name FROM part WHERE p_partkey = 0 OR p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"),
        "column_groups": (column_groups, "WITH e AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS top FROM events), f AS (SELECT *, CASE WHEN top <= lag(top) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS fresh FROM e) SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS \"group\" FROM f"),
        "column_assignment": (column_assignment, COLUMNS),
    }
