"""Renderings: pages to Markdown, tables to Markdown and HTML, styled runs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.operators import pages as P
from inkstone.operators import render
from inkstone.operators import tables as T
from inkstone.plans.relations import read
from inkstone.plans.scalars import sql_outline


def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return P.page_markdown(read(spark, d, "pages"))


def page_links(spark, d):
    return P.page_links(read(spark, d, "pages"))


def page_preview_text(spark, d):
    return P.page_preview(read(spark, d, "pages"))


def order_cells(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as tables, one for each order: a row for each line number, its first quantity and part in two cells."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("t"), (F.col("l_linenumber") - 1).cast("long").alias("row")).agg(F.min(F.col("l_quantity").cast("long")).alias("q"), F.min("l_partkey").alias("p"))
    cells = F.array(F.struct(F.lit(0).cast("long").alias("col"), F.col("q").cast("string").alias("text"), F.col("q").alias("v")), F.struct(F.lit(1).cast("long").alias("col"), F.col("p").cast("string").alias("text"), F.col("p").alias("v")))
    out = rows.select("t", "row", F.explode(cells).alias("c")).select("t", "row", "c.col", "c.text", "c.v")
    return out.withColumn("row_span", F.when(F.pmod("v", F.lit(5)) == 0, F.lit(2)).otherwise(F.lit(1))).withColumn("col_span", F.lit(1)).withColumn("height", F.pmod("v", F.lit(97)))


CELLS = """WITH r AS (SELECT l_orderkey AS t, CAST(l_linenumber - 1 AS BIGINT) AS "row", min(CAST(l_quantity AS BIGINT)) AS q, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
c AS (SELECT t, "row", 0 AS col, q AS v FROM r UNION ALL SELECT t, "row", 1, p FROM r),
cells AS (SELECT *, CAST(v AS VARCHAR) AS text, CASE WHEN v % 5 = 0 THEN 2 ELSE 1 END AS row_span, v % 97 AS height FROM c)"""


def table_markdown(spark, d):
    return T.markdown_table(order_cells(spark, d), ["t"])


def semantic_html_table(spark, d):
    return T.html_table(order_cells(spark, d), ["t"])


def table_grid_positions(spark, d):
    return T.grid_positions(order_cells(spark, d), ["t"]).select("t", "row", "height", "top")


def rowspan_cover(spark, d):
    cells = order_cells(spark, d)
    slots = T.covered_slots(cells, ["t"])
    hidden = slots.where("not origin").select("t", F.col("slot_row").alias("row"), F.col("slot_col").alias("col")).distinct()
    return cells.join(hidden, ["t", "row", "col"], "left_anti").select("t", "row", "col", "text")


def zone_override(spark, d):
    cells = order_cells(spark, d).withColumn("cell_fill", F.pmod("v", F.lit(3))).withColumn("table_fill", F.lit(9).cast("long"))
    names = ("zone_ord", "top", "bottom", "left", "right", "zone_fill")
    each = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(names, zone, strict=True))) for zone in ((0, 0, 1, 0, 0, 5), (1, 1, 3, 0, 1, 6), (2, 0, 2, 1, 1, 0))))
    zones = read(spark, d, "orders").select(F.col("o_orderkey").alias("t"), F.inline(each))
    return T.zone_fill(cells, zones, ["t"]).select("t", "row", "col", "fill")


def styled(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.col("l_returnflag"), F.lit("&"), F.col("l_partkey").cast("string")).alias("t"), *((F.pmod(F.expr(f"l_partkey div {k}"), F.lit(2)) == 1).alias(n) for k, n in ((1, "b"), (2, "i"), (4, "s"))))


def char_style_markdown(spark, d):
    return styled(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", X.markdown_style(F.col("t"), F.col("b"), F.col("i"), F.col("s")).alias("text"))


def char_style_html(spark, d):
    return styled(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", X.html_style(F.col("t"), F.col("b"), F.col("i"), F.col("s")).alias("text"))


def detect_format(spark, d):
    signature = F.element_at(F.array(*map(F.lit, ("D0CF11E0A1B11AE1", "504B0304", "3C21"))), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", X.detect_format(F.concat(F.unhex(signature), F.col("html").cast("binary"))).alias("format"))


def json_export(spark, d):
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.groupBy("r_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))).alias("json"))


def css_rules(spark, d):
    """Style rules of each brand's parts, as character shapes and paragraph shapes."""
    p = read(spark, d, "part").withColumn("file", F.col("p_brand"))
    chars = p.select("file", F.col("p_partkey").alias("id"), (F.col("p_size") * 100).cast("long").alias("height"), (F.pmod("p_size", F.lit(2)) == 1).alias("bold"), (F.pmod("p_size", F.lit(3)) == 0).alias("italic"), F.col("p_partkey").alias("colour"), F.lit(None).cast("long").alias("shade"), F.lit(0).cast("long").alias("font"))
    paras = p.select("file", F.col("p_partkey").alias("id"), F.pmod("p_partkey", F.lit(6)).alias("align"), (F.col("p_size") * 720).cast("long").alias("left"), *(F.lit(0).cast("long").alias(c) for c in ("right", "indent", "before", "after")))
    return render.document_css({"char_shapes": chars, "para_shapes": paras}, "x-").withColumnRenamed("file", "p_brand")


def image_names(spark, d):
    return read(spark, d, "part").select("p_partkey", F.format_string("BIN%04X", "p_partkey").alias("bin_id"), F.concat(F.lit("image-"), F.col("p_partkey").cast("string")).alias("placeholder"))


def sql_content() -> str:
    t = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in P.DROPPED:
        t = f"regexp_replace({t}, '(?s)<{tag}( [^>]*)?>.*?</{tag}>', '', 'g')"
    return f"regexp_replace({t}, '(?s)<div class=\"ad[^>]*>.*?</div>', '', 'g')"


def sql_visible(e: str) -> str:
    e = f"regexp_replace({e}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def page_markdown_sql() -> str:
    split = f"string_split(regexp_replace({sql_content()}, '{P.BLOCKS}', chr(30) || '<\\1>', 'g'), chr(30))"
    w = "OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whens = " ".join(f"WHEN level = {k} THEN coalesce(max(CASE WHEN level < {k} THEN pos END) {w}, -1)" for k in range(1, 8))
    return f"""WITH s AS (SELECT page_id, unnest({split}) AS block, generate_subscripts({split}, 1) - 1 AS pos FROM pages),
b AS (SELECT page_id, pos, regexp_extract(block, '^<([a-z0-9]+)', 1) AS kind, {sql_visible('block')} AS text FROM s),
v AS (SELECT *, CASE WHEN regexp_matches(kind, '^h[1-9]$') THEN CAST(substring(kind, 2, 1) AS BIGINT) ELSE 9 END AS level FROM b WHERE text <> ''),
g AS (SELECT *, CASE {whens} END AS grp FROM v),
n AS (SELECT *, CASE WHEN level <= 7 THEN row_number() OVER (PARTITION BY page_id, level, grp ORDER BY pos) ELSE 0 END AS num FROM g),
l AS (SELECT page_id, pos, CASE WHEN regexp_matches(kind, '^h[1-7]$') THEN repeat('#', CAST(level AS INTEGER)) || ' ' || ({sql_outline('level', 'num')}) || ' ' || text WHEN kind = 'li' THEN '- ' || text ELSE text END AS line FROM n)
SELECT page_id, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS markdown FROM l GROUP BY page_id"""


CSS = """WITH r AS (SELECT p_brand, 1 AS part, p_partkey AS id, '.x-cs-' || p_partkey || ' { ' || concat_ws('; ', CASE WHEN p_size <> 0 THEN 'font-size: ' || printf('%.1f', CAST(p_size AS DOUBLE)) || 'pt' END, CASE WHEN p_size % 2 = 1 THEN 'font-weight: bold' END, CASE WHEN p_size % 3 = 0 THEN 'font-style: italic' END,
  CASE WHEN p_partkey <> 0 THEN 'color: rgb(' || (p_partkey & 255) || ',' || ((p_partkey >> 8) & 255) || ',' || ((p_partkey >> 16) & 255) || ')' END) || ' }' AS rule FROM part
UNION ALL SELECT p_brand, 2, p_partkey, '.x-ps-' || p_partkey || ' { ' || concat_ws('; ', 'text-align: ' || CASE p_partkey % 6 WHEN 0 THEN 'justify' WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'center' END,
  CASE WHEN p_size <> 0 THEN 'margin-left: ' || CASE WHEN mm = floor(mm) THEN CAST(CAST(mm AS BIGINT) AS VARCHAR) ELSE printf('%.2f', mm) END || 'mm' END) || ' }' FROM (SELECT *, round(p_size * 720 / 7200 * 25.4 * 100, 0) / 100 AS mm FROM part) WHERE p_size <> 0 OR p_partkey % 6 < 4)
SELECT p_brand, '.x-table { border-collapse: collapse }' || chr(10) || string_agg(rule, chr(10) ORDER BY part, id) AS css FROM r WHERE NOT ends_with(rule, '{  }') GROUP BY 1"""


def catalog() -> dict:
    links = "regexp_extract_all(html, '(?s)(<a [^>]*href=\"[^\"]*\"[^>]*>.*?</a>)', 1)"
    style = "SELECT l_orderkey, l_linenumber, l_partkey, {e} AS text FROM (SELECT *, {t} AS t, l_partkey % 2 = 1 AS b, (l_partkey // 2) % 2 = 1 AS i, (l_partkey // 4) % 2 = 1 AS s FROM lineitem)"
    md = "(CASE WHEN s THEN '~~' ELSE '' END || CASE WHEN b THEN '**' ELSE '' END || CASE WHEN i THEN '*' ELSE '' END || t || CASE WHEN i THEN '*' ELSE '' END || CASE WHEN b THEN '**' ELSE '' END || CASE WHEN s THEN '~~' ELSE '' END)"
    html = "(CASE WHEN s THEN '<del>' ELSE '' END || CASE WHEN b THEN '<strong>' ELSE '' END || CASE WHEN i THEN '<em>' ELSE '' END || t || CASE WHEN i THEN '</em>' ELSE '' END || CASE WHEN b THEN '</strong>' ELSE '' END || CASE WHEN s THEN '</del>' ELSE '' END)"
    return {
        "page_markdown": (page_markdown, page_markdown_sql()),
        "page_links": (page_links, f"WITH l AS (SELECT page_id, unnest({links}) AS link, generate_subscripts({links}, 1) - 1 AS pos FROM pages) SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(link, 'href=\"([^\"]*)\"', 1) AS url, {sql_visible('link')} AS anchor FROM l"),
        "page_preview_text": (page_preview_text, f"SELECT page_id, substring({sql_visible(sql_content())}, 1, 160) AS preview FROM pages"),
        "table_markdown": (table_markdown, CELLS + """, l AS (SELECT t, "row", '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' || CASE WHEN "row" = min("row") OVER (PARTITION BY t) THEN chr(10) || '| --- | --- |' ELSE '' END AS line FROM cells GROUP BY t, "row") SELECT t, string_agg(line, chr(10) ORDER BY "row") AS markdown FROM l GROUP BY t"""),
        "semantic_html_table": (semantic_html_table, CELLS + """, l AS (SELECT t, "row", '<tr>' || string_agg('<td' || CASE WHEN row_span > 1 THEN ' rowspan="2"' ELSE '' END || '>' || text || '</td>', '' ORDER BY col) || '</tr>' AS line FROM cells GROUP BY t, "row") SELECT t, '<table>' || string_agg(line, '' ORDER BY "row") || '</table>' AS html FROM l GROUP BY t"""),
        "table_grid_positions": (table_grid_positions, CELLS + """, h AS (SELECT t, "row", coalesce(max(CASE WHEN row_span <= 1 THEN height END), 0) AS height FROM cells GROUP BY 1, 2) SELECT t, "row", height, CAST(coalesce(sum(height) OVER (PARTITION BY t ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM h"""),
        "rowspan_cover": (rowspan_cover, CELLS + """ SELECT t, "row", CAST(col AS BIGINT) AS col, text FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.t = a.t AND b.col = a.col AND b."row" = a."row" - 1 AND b.row_span = 2)"""),
        "zone_override": (zone_override, CELLS + """ SELECT t, "row", CAST(col AS BIGINT) AS col, CAST(CASE WHEN "row" BETWEEN 1 AND 3 THEN 6 WHEN "row" BETWEEN 0 AND 1 AND col = 0 THEN 5 WHEN v % 3 <> 0 THEN v % 3 ELSE 9 END AS BIGINT) AS fill FROM cells"""),
        "char_style_markdown": (char_style_markdown, style.replace("{t}", "l_returnflag || '&' || CAST(l_partkey AS VARCHAR)").replace("{e}", md)),
        "char_style_html": (char_style_html, style.replace("{t}", "l_returnflag || '&amp;' || CAST(l_partkey AS VARCHAR)").replace("{e}", html)),
        "detect_format": (detect_format, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'compound' WHEN 1 THEN 'package' ELSE 'unknown' END AS format FROM pages"),
        "json_export": (json_export, """SELECT n_regionkey AS r_regionkey, '[' || string_agg('{"id":' || CAST(n_nationkey AS VARCHAR) || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation GROUP BY 1"""),
        "css_rules": (css_rules, CSS),
        "image_names": (image_names, "SELECT p_partkey, printf('BIN%04X', p_partkey) AS bin_id, 'image-' || CAST(p_partkey AS VARCHAR) AS placeholder FROM part"),
    }
