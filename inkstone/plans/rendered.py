"""Rendered documents: rows are written as packages with links, numbers, notes, pictures, captions and lines, and rendered. SQL twins build the same texts from the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import html_escape
from inkstone.operators import inline, layout, render, renderers, views
from inkstone.operators.tables import ordered
from inkstone.plans.relations import read, spread
from inkstone.sources import documents
from inkstone.sources.writer import to_files

HEAD = """<head><beginNum page="1" tbl="4"/><charPr id="0"/><charPr id="1"><italic/></charPr><paraPr id="0"/><paraPr id="1"><heading type="BULLET" idRef="0" level="0"/></paraPr><paraPr id="2"><heading type="NUMBER" idRef="0" level="0"/></paraPr>
<paraPr id="3"><heading type="OUTLINE" level="1"/></paraPr><bullet id="1" char="&#xF0A7;"/><numbering id="1"><paraHead level="1" numFormat="ROMAN_SMALL">(^1)</paraHead></numbering></head>"""
MANIFEST = '<package><metadata><title>T</title></metadata><manifest><item id="image1" href="BinData/image1.png"/></manifest></package>'


def xml(*parts: str | Column) -> Column:
    """XML text; columns are escaped."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else html_escape(p.cast("string")) for p in parts))


def run_of(text: Column, shape: int = 0) -> tuple:
    return (f'<run charPrIDRef="{shape}"><t>', text, "</t></run>")


def link(url: tuple, *inner: str | Column) -> tuple:
    return ('<run charPrIDRef="0"><ctrl><fieldBegin type="HYPERLINK"><parameters><stringParam name="Command">', *url, '|;1;0;</stringParam></parameters></fieldBegin></ctrl></run>', *inner, '<run charPrIDRef="0"><ctrl><fieldEnd/></ctrl></run>')


def para(shape: int, *inner: str | Column) -> tuple:
    return (f'<p paraPrIDRef="{shape}">', *inner, "</p>")


def files_of(spark: SparkSession, d: str, body: Column, head: str = HEAD) -> DataFrame:
    """A package for each brand, whose section holds the pieces of its parts."""
    held = read(spark, d, "part").withColumn("piece", body).groupBy(F.col("p_brand").alias("file")).agg(ordered(["p_partkey"], "piece", "").alias("xml"))
    section = F.concat(F.lit('<sec><p paraPrIDRef="0"><run charPrIDRef="0"><secPr><pagePr width="59528" height="84188"><margin left="8504" right="8504" top="5668" bottom="4252" header="4252" footer="4252"/></pagePr></secPr></run></p>'), "xml", F.lit("</sec>"))
    binary = lambda t: F.lit(t).cast("binary")
    parts = F.create_map(F.lit("Contents/header.xml"), binary(head), F.lit("Contents/content.hpf"), binary(MANIFEST), F.lit("BinData/image1.png"), binary("PNG"), F.lit("Contents/section0.xml"), section.cast("binary"))
    return to_files(spread(held, "file"), F.col("file"), parts, "package")


def tables_of(spark: SparkSession, d: str, body: Column, names: tuple[str, ...] = (*render.TEXT_TABLES, "bullets", "bin_items", "settings", "note_shapes", "captions"), head: str = HEAD) -> dict[str, DataFrame]:
    return documents.read_tables(files_of(spark, d, body, head), names)


def name() -> Column:
    return F.col("p_name")


def mixed() -> Column:
    """Five paragraphs for each part: an outline heading, a bullet, a link over two runs of different style, a numbered item, a note."""
    note = ('<run charPrIDRef="0"><ctrl><footNote><subList>', *para(0, *run_of(F.col("p_size"))), "</subList></footNote></ctrl></run>")
    first, rest = F.substring(name(), 1, 3), F.expr("substring(p_name, 4)")
    return xml(*para(3, *run_of(F.col("p_type"))), *para(1, *run_of(name())), *para(0, *run_of(F.lit("see ")), *link(("http://x/", F.col("p_partkey")), *run_of(first), *run_of(rest, 1)), *run_of(F.lit(" end"))), *para(2, *run_of(F.col("p_brand"))), *para(0, *run_of(F.lit("noted")), *note))


def rendered_markdown(spark, d):
    return render.document_text(tables_of(spark, d, mixed())).select("file", F.col("text").alias("markdown"))


def rendered_html(spark, d):
    return render.document_text(tables_of(spark, d, mixed()), html=True, options=renderers.Options(css_prefix="z-")).select("file", F.col("text").alias("html"))


def rendered_plain(spark, d):
    """The same in the plain renderer of the registry."""
    return render.document_text(tables_of(spark, d, mixed()), name="text")


def word_links(spark, d):
    """Links that begin inside a word stay text; open ones end with their paragraph; empty ones show their address."""
    k = F.pmod("p_partkey", F.lit(3))
    inside = xml(*para(0, *run_of(name()), *link(("http://x/", F.col("p_partkey")), *run_of(F.lit("tail")))))
    open_ = xml(*para(0, *run_of(F.lit("to ")), '<run charPrIDRef="0"><ctrl><fieldBegin type="HYPERLINK"><parameters><stringParam name="Command">', F.lit("http://open/"), F.col("p_partkey"), '|;1;0;</stringParam></parameters></fieldBegin></ctrl></run>', *run_of(name())))
    empty = xml(*para(0, *link(("http://e/", F.col("p_partkey")))))
    t = tables_of(spark, d, F.when(k == 0, inside).when(k == 1, open_).otherwise(empty))
    return inline.paragraph_texts(t, renderers.renderer("markdown")).where("text <> ''").select("file", "path", "text")


def picture_markdown(spark, d):
    """Pictures of a part and of none, as files of a folder."""
    target = F.when(F.pmod("p_size", F.lit(2)) == 0, F.lit("image1")).otherwise(F.lit("gone"))
    body = xml(*para(0, '<run charPrIDRef="0"><pic><img binaryItemIDRef="', target, '"/></pic></run>', *run_of(name())))
    r = renderers.renderer("markdown", renderers.Options(image_folder="out/img", html_folder="out"))
    return inline.paragraph_texts(tables_of(spark, d, body), r).where("text <> ''").select("file", "path", "text")


def embedded_pictures(spark, d):
    body = xml(*para(0, '<run charPrIDRef="0"><pic><img binaryItemIDRef="image1"/></pic></run>', *run_of(name())))
    t = tables_of(spark, d, body, (*render.TEXT_TABLES, "bin_items", "binaries"))
    return inline.paragraph_texts(t, renderers.renderer("html", renderers.Options(embed_images=True))).where("text <> ''").select("file", "path", "text")


def captioned() -> Column:
    """A table of one cell with a caption that holds its automatic number; above it for even sizes."""
    side = F.when(F.pmod("p_size", F.lit(2)) == 0, F.lit("TOP")).otherwise(F.lit("BOTTOM"))
    number = '<run charPrIDRef="0"><ctrl><autoNum num="1" numType="TABLE"><autoNumFormat type="ROMAN_CAPITAL"/></autoNum></ctrl></run>'
    caption = ('<caption side="', side, '"><subList>', *para(0, *run_of(F.lit("Tab ")), number, *run_of(F.concat(F.lit(" of "), name()))), "</subList></caption>")
    cell = ("<tr><tc><subList>", *para(0, *run_of(F.col("p_size"))), '</subList><cellAddr colAddr="0" rowAddr="0"/><cellSz width="7200" height="720"/></tc></tr>')
    box = ('<run charPrIDRef="0"><rect><drawText><subList>', *para(0, *run_of(F.col("p_size"))), "</subList></drawText></rect></run>")
    return xml(*para(0, *run_of(F.lit("T")), '<run charPrIDRef="0"><tbl rowCnt="1" colCnt="1">', *caption, *cell, "</tbl></run>", *box))


def captions_in_markdown(spark, d):
    return render.document_text(tables_of(spark, d, captioned())).select("file", F.col("text").alias("markdown"))


def caption_texts(spark, d):
    return views.caption_texts(tables_of(spark, d, captioned()))


def page_rules(spark, d):
    """Paragraphs that ask for a new page stand below a rule, the first one doesn't."""
    asked = F.when(F.pmod("p_size", F.lit(4)) == 0, F.lit("1")).otherwise(F.lit("0"))
    body = xml('<p paraPrIDRef="0" pageBreak="', asked, '">', *run_of(name()), "</p>")
    return render.document_text(tables_of(spark, d, body)).select("file", F.col("text").alias("markdown"))


def version_lines(spark, d):
    t = tables_of(spark, d, xml(*para(0, *run_of(name()))), (*render.TEXT_TABLES, "headers", "pages"))
    found = render.document_text(t, options=renderers.Options(include_version=True, include_page_info=True))
    return found.select("file", F.substring_index("text", "\n\n", 2).alias("top"))


def section_restart(spark, d):
    """Notes whose numbers begin anew in each section: a file of two sections for each part."""
    notes = '<sec><p paraPrIDRef="0"><run charPrIDRef="0"><secPr><footNotePr><numbering type="%s"/></footNotePr></secPr></run></p>'
    body = '<p paraPrIDRef="0"><run charPrIDRef="0"><ctrl><autoNum num="1" numType="FOOTNOTE"/></ctrl></run><run charPrIDRef="0"><ctrl><autoNum num="1" numType="FOOTNOTE"/></ctrl></run></p></sec>'
    rule = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.lit("ON_SECTION")).otherwise(F.lit("CONTINUOUS"))
    section = F.concat(F.lit(notes.split("%s")[0]), rule, F.lit(notes.split("%s")[1] + body)).cast("binary")
    parts = F.create_map(F.lit("Contents/header.xml"), F.lit("<head/>").cast("binary"), F.lit("Contents/section0.xml"), section, F.lit("Contents/section1.xml"), section)
    t = documents.read_tables(to_files(read(spark, d, "part"), F.col("p_partkey"), parts, "package"), ("controls", "settings", "note_shapes"))
    found = inline.automatic_numbers(t["controls"], t["settings"], t["note_shapes"])
    return found.select(F.col("file").cast("long").alias("p_partkey"), "path", "n")


def spine_sections(spark, d):
    """Sections whose parts have names of their own: the manifest, which the container names, gives their order in its spine."""
    manifest = '<package><manifest><item id="b" href="Contents/body.xml"/><item id="a" href="Contents/after.xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
    piece = lambda t: xml("<sec>", *para(0, *run_of(t)), "</sec>").cast("binary")
    container = '<container><rootfiles><rootfile full-path="Other/root.opf" media-type="application/hwpml-package+xml"/></rootfiles></container>'
    parts = F.create_map(F.lit("META-INF/container.xml"), F.lit(container).cast("binary"), F.lit("Other/root.opf"), F.lit(manifest).cast("binary"), F.lit("Contents/body.xml"), piece(F.col("url")), F.lit("Contents/after.xml"), piece(F.col("page_id")))
    found = documents.read_table(to_files(read(spark, d, "pages"), F.col("page_id"), parts, "package"), "runs")
    return found.select(F.col("file").cast("long").alias("page_id"), "path", "text")


def lined() -> Column:
    """A paragraph of two lines, the second below the first."""
    segments = '<linesegarray><lineseg textpos="0" vertpos="0" vertsize="1000" horzsize="42520"/><lineseg textpos="3" vertpos="1600" vertsize="1000" horzsize="42520"/></linesegarray>'
    return xml(*para(0, *run_of(name()), segments))


def package_of_each(spark: SparkSession, d: str, body: Column) -> DataFrame:
    """A package for each part."""
    section = F.concat(F.lit('<sec><p paraPrIDRef="0"><run charPrIDRef="0"><secPr><pagePr width="59528" height="84188"><margin left="8504" right="8504" top="5668" bottom="4252" header="4252" footer="4252"/></pagePr></secPr></run></p>'), body, F.lit("</sec>"))
    parts = F.create_map(F.lit("Contents/header.xml"), F.lit(HEAD).cast("binary"), F.lit("Contents/section0.xml"), section.cast("binary"))
    return to_files(spread(read(spark, d, "part"), "p_partkey"), F.col("p_partkey"), parts, "package")


def layout_pages(spark, d):
    t = documents.read_tables(package_of_each(spark, d, lined()), ("paragraphs", "runs", "line_segments", "pages"))
    return layout.layout_html(t).select(F.col("file").cast("long").alias("p_partkey"), "page", "number", "html")


def page_files(spark, d):
    """Placed pages as HTML files that share a style sheet."""
    t = documents.read_tables(package_of_each(spark, d, lined()), ("paragraphs", "runs", "line_segments", "pages", "char_shapes", "para_shapes", "fonts"))
    found = render.page_files(layout.layout_html(t), render.document_css(t))
    return found.where("name like '%.html'").select("name", F.md5("data").alias("digest"))


def synthetic_lines(spark, d):
    """Lines for documents that have none: as many as their text needs cells of the page's width."""
    long = F.repeat(F.concat(name(), F.lit(" ")), (F.col("p_size") + 1).cast("int"))
    t = documents.read_tables(package_of_each(spark, d, xml(*para(0, *run_of(long)))), ("paragraphs", "runs", "line_segments", "pages"))
    found = layout.synthetic_segments(t["paragraphs"], t["runs"], t["pages"], t["line_segments"])
    return found.where("path <> '0000.000000'").groupBy(F.col("file").cast("long").alias("p_partkey")).agg(F.count("*").alias("lines"), F.max("top").alias("lowest"), F.max("width").alias("width"))


def files_with_lines(spark, d):
    body = F.when(F.pmod("p_partkey", F.lit(2)) == 0, lined()).otherwise(xml(*para(0, *run_of(name()))))
    t = documents.read_tables(package_of_each(spark, d, body), ("paragraphs", "line_segments"))
    return views.files_with_lines(t["paragraphs"], t["line_segments"]).select(F.col("file").cast("long").alias("p_partkey"), "has_lines")


def document_info(spark, d):
    t = documents.read_tables(package_of_each(spark, d, xml(*para(0, *run_of(name())))), ("headers", "paragraphs", "binaries"))
    return views.info(t).select(F.col("file").cast("long").alias("p_partkey"), "version", "format", "sections", "paragraphs", "images")


def document_json(spark, d):
    t = documents.read_tables(package_of_each(spark, d, xml(*para(0, *run_of(name())))), ("runs", "paragraphs", "headers"))
    return render.document_json(t).select(F.col("file").cast("long").alias("p_partkey"), "json")


def sql_mm(units: str) -> str:
    r = f"(round({units} / 7200.0 * 25.4 * 100, 0) / 100)"
    return f"CASE WHEN {r} = 0 THEN '0.00mm' WHEN {r} = floor({r}) THEN CAST(CAST({r} AS BIGINT) AS VARCHAR) || 'mm' ELSE printf('%.2f', {r}) || 'mm' END"


def catalog() -> dict:
    from inkstone.plans.scalars import sql_roman

    k = "(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)"
    nl = "chr(10) || chr(10)"
    path = "'0000.' || printf('%06d', k)"
    # The outline counts 가, 나, 다 ... in fourteens on its second level.
    mark = "substring('가나다라마바사아자차카타파하', CAST((k - 1) % 14 + 1 AS INTEGER), 1) || '.'"
    roman = "lower(" + sql_roman("k") + ")"
    md = f"'## ' || {mark} || ' ' || p_type || {nl} || '- ' || p_name || {nl} || 'see [' || substring(p_name, 1, 3) || '*' || substring(p_name, 4) || '*](http://x/' || p_partkey || ') end' || {nl} || '(' || {roman} || ') ' || p_brand || {nl} || 'noted[^' || k || ']'"
    plain = f"{mark} || ' ' || p_type || {nl} || '- ' || p_name || {nl} || 'see ' || p_name || ' end' || {nl} || '(' || {roman} || ') ' || p_brand || {nl} || 'noted(' || k || ')'"
    span = lambda t, s=0: f"'<span class=\"z-cs-{s}\">' || {t} || '</span>'"
    html = (
        f"'<h2 class=\"z-outline-2\"><span class=\"z-outline-number\">' || {mark} || '</span> ' || {span('p_type')} || '</h2>' || chr(10) || '<p>■ ' || {span('p_name')} || '</p>' || chr(10) || '<p class=\"z-ps-0\">' || {span(repr('see '))} || '<a href=\"http://x/' || p_partkey || '\">' || {span('substring(p_name, 1, 3)')} || "
        f"'<span class=\"z-cs-1\"><em>' || substring(p_name, 4) || '</em></span></a>' || {span(repr(' end'))} || '</p>' || chr(10) || '<p>(' || {roman} || ') ' || {span('p_brand')} || '</p>' || chr(10) || '<p class=\"z-ps-0\">' || {span(repr('noted'))} || '<sup id=\"fnref-' || k || '\"><a href=\"#fn-' || k || '\">' || k || '</a></sup></p>'"
    )
    note = "'<div class=\"z-note\" id=\"fn-' || k || '\"><a href=\"#fnref-' || k || '\">' || k || ')</a> <p class=\"z-ps-0\"><span class=\"z-cs-0\">' || p_size || '</span></p></div>'"
    whole = lambda body, notes, sep, name: f"SELECT p_brand AS file, string_agg({body}, {sep} ORDER BY k) || {sep} || string_agg({notes}, {sep} ORDER BY k) AS {name} FROM {k} GROUP BY 1"
    up = sql_roman("(k + 3)")
    caption = f"'Tab ' || {up} || ' of ' || p_name"
    grid = "'| ' || p_size || ' |' || chr(10) || '| --- |'"
    shown = lambda t: f"regexp_replace({t}, '^ | $', '&nbsp;', 'g')"
    line = lambda text, y: f"'<div class=\"line cs-0\" style=\"left:' || {sql_mm('8504')} || ';top:' || {sql_mm(y)} || '\">' || {text} || '</div>'"
    placed = f"'<div class=\"page\" style=\"width:' || {sql_mm('59528')} || ';height:' || {sql_mm('84188')} || '\">' || {line(shown('substring(p_name, 1, 3)'), '(5668 + 4252)')} || {line(shown('substring(p_name, 4)'), '(5668 + 4252 + 1600)')} || '<div class=\"number\">1</div></div>'"
    return {
        "rendered_markdown": (rendered_markdown, whole(md, "'[^' || k || ']: ' || p_size", nl, "markdown")),
        "rendered_html": (rendered_html, f"SELECT file, '<article>' || chr(10) || html || chr(10) || '</article>' AS html FROM ({whole(html, note, 'chr(10)', 'html')})"),
        "rendered_plain": (rendered_plain, whole(plain, "k || ') ' || p_size", nl, "text")),
        "word_links": (word_links, f"SELECT p_brand AS file, {path} AS path, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN regexp_matches(p_name, '[a-zA-Z0-9]$') THEN p_name || 'tail' ELSE p_name || '[tail](http://x/' || p_partkey || ')' END WHEN 1 THEN 'to [' || p_name || '](http://open/' || p_partkey || ')' ELSE '[http://e/' || p_partkey || '](http://e/' || p_partkey || ')' END AS text FROM {k}"),
        "picture_markdown": (picture_markdown, f"SELECT p_brand AS file, {path} AS path, '![이미지](' || CASE WHEN p_size % 2 = 0 THEN 'img/image1.png' ELSE 'gone' END || ')' || p_name AS text FROM {k}"),
        "embedded_pictures": (embedded_pictures, f"SELECT p_brand AS file, {path} AS path, '<img src=\"data:image/png;base64,UE5H\" alt=\"이미지\"><span class=\"cs-0\">' || p_name || '</span>' AS text FROM {k}"),
        "captions_in_markdown": (captions_in_markdown, f"SELECT p_brand AS file, string_agg('T' || {nl} || CASE WHEN p_size % 2 = 0 THEN {caption} || {nl} || {grid} ELSE {grid} || {nl} || {caption} END, {nl} ORDER BY k) AS markdown FROM {k} GROUP BY 1"),
        "caption_texts": (caption_texts, f"SELECT p_brand AS file, {path} || '.c000' AS control, CASE WHEN p_size % 2 = 0 THEN 'top' ELSE 'bottom' END AS side, 'Tab' AS label, {up} AS number, 'of ' || p_name AS body FROM {k}"),
        "page_rules": (page_rules, f"SELECT p_brand AS file, string_agg(CASE WHEN p_size % 4 = 0 AND k > 1 THEN '---' || {nl} ELSE '' END || p_name, {nl} ORDER BY k) AS markdown FROM {k} GROUP BY 1"),
        "version_lines": (version_lines, f"SELECT DISTINCT p_brand AS file, '**버전**: 5.1.0.0' || {nl} || '**용지 크기**: ' || {sql_mm('59528')} || ' x ' || {sql_mm('84188')} AS top FROM part"),
        "section_restart": (section_restart, "SELECT p_partkey, printf('%04d.000001.c%03d', s, c) AS path, CAST(c + 1 + CASE WHEN p_partkey % 2 = 1 THEN 2 * s ELSE 0 END AS BIGINT) AS n FROM part, (SELECT unnest([0, 1]) AS s), (SELECT unnest([0, 1]) AS c)"),
        "spine_sections": (spine_sections, "SELECT page_id, '0000.000000' AS path, url AS text FROM pages UNION ALL SELECT page_id, '0001.000000', CAST(page_id AS VARCHAR) FROM pages"),
        "page_files": (page_files, f"SELECT CAST(p_partkey AS VARCHAR) || '-' || substring(md5(CAST(p_partkey AS VARCHAR)), 1, 8) || '/page-0001.html' AS name, md5('<!DOCTYPE html><html><head><meta charset=\"utf-8\"><link rel=\"stylesheet\" href=\"style.css\"></head><body>' || {placed} || '</body></html>') AS digest FROM part"),
        "layout_pages": (layout_pages, f"SELECT p_partkey, CAST(1 AS BIGINT) AS page, CAST(1 AS BIGINT) AS number, {placed} AS html FROM part"),
        "synthetic_lines": (synthetic_lines, "SELECT p_partkey, lines, (lines - 1) * 1600 + 1600 AS lowest, CAST(42520 AS BIGINT) AS width FROM (SELECT p_partkey, CAST(greatest(1, ceil((length(p_name) + 1) * (p_size + 1) * 500 / 42520.0)) AS BIGINT) AS lines FROM part)"),
        "files_with_lines": (files_with_lines, "SELECT p_partkey, p_partkey % 2 = 0 AS has_lines FROM part"),
        "document_info": (document_info, "SELECT p_partkey, '5.1.0.0' AS version, 'package' AS format, CAST(1 AS BIGINT) AS sections, CAST(2 AS BIGINT) AS paragraphs, CAST(0 AS BIGINT) AS images FROM part"),
        "document_json": (document_json, """SELECT p_partkey, '{"paragraphs":[{"path":"0000.000000","section":0,"para_shape":0,"style":0,"page_break":false,"runs":[{"ord":0,"kind":"control:secPr","text":"secd","char_shape":0}]},{"path":"0000.000001","section":0,"para_shape":0,"style":0,"page_break":false,"runs":[{"ord":0,"kind":"text","text":"' || p_name || '","char_shape":0}]}],"header":{"version":"5.1.0.0","format":"package"}}' AS json FROM part"""),
    }
