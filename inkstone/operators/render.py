"""Decoded documents to Markdown, HTML and JSON: ordered aggregations from the leaves up, tables before the paragraphs that hold them.

All functions take the tables of inkstone.sources.documents (read_table or read_tables), keyed by file and path; paths sort like the document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import numbering as N
from inkstone.functions import text as X
from inkstone.functions import values as V
from inkstone.operators.inline import note_numbers, paragraph_texts
from inkstone.operators.renderers import Options, Renderer, lit, renderer
from inkstone.operators.sequences import outline_numbers
from inkstone.operators.tables import ordered, zone_fill

#: The tables that a document's text is made of; those after the bar only where they are given.
TEXT_TABLES = ("runs", "paragraphs", "char_shapes", "para_shapes", "numberings", "cells", "controls")
MORE_TABLES = ("bullets", "styles", "bin_items", "settings", "note_shapes", "captions", "headers", "pages", "border_fills", "tables", "zones")
#: Where a paragraph stands, by the control that holds its container.
PLACES = {"head": 0, "foot": 2, "fn  ": 3, "en  ": 4}
HIDDEN = ("tcmt", "hide")


def extended_level(paras: DataFrame, styles: DataFrame | None) -> Column:
    """The outline level 8 to 10 that a paragraph of level 7 has by its line spacing (7 to 10) and the number in its style's name."""
    base, spacing = F.col("level"), F.col("spacing")
    named = F.regexp_extract("style_name", "^개요 \\s*([0-9]+)\\s*$", 1).try_cast("long") if styles is not None else F.lit(None).cast("long")
    deeper = F.when(named.between(8, 10), named).otherwise(spacing + 1)
    return F.when((base == 7) & (F.col("heading") == 1) & spacing.between(7, 10), deeper).otherwise(base)


def paragraph_lines(tables: dict[str, DataFrame], r: Renderer) -> DataFrame:
    """file, path, container, page_break, plain, line: text of each paragraph with its heading, number or bullet."""
    text = paragraph_texts(tables, r)
    shapes = tables["para_shapes"].select("file", F.col("id").alias("para_shape"), "heading", "level", "numbering", "spacing")
    paras = tables["paragraphs"].join(shapes, ["file", "para_shape"], "left").join(text, ["file", "path"], "left").na.fill({"text": "", "heading": 0, "level": 1, "numbering": 0, "spacing": 0})
    if "styles" in tables:
        paras = paras.join(tables["styles"].select("file", F.col("id").alias("style"), F.col("name").alias("style_name")), ["file", "style"], "left")
    paras = paras.withColumn("level", extended_level(paras, tables.get("styles")))
    # A paragraph without a number stands in a partition of its own kind and counts there without effect.
    lists = paras.withColumn("list", F.when(F.col("heading") == 2, F.col("numbering")).otherwise(F.lit(0)))
    headed = outline_numbers(lists, ["file", "heading", "list"], "path", "level")
    formats = tables["numberings"].select("file", F.col("id").alias("list"), "formats", "kinds")
    at = (F.col("level") - 1).cast("int")
    own = N.numbered(F.get("formats", at), F.col("level"), N.narrow_kind(F.get("kinds", at)), F.col("n"))
    mark = F.when(F.col("level") > 7, F.lit("")).when(F.col("heading") == 1, N.outline_format(F.col("level"), F.col("n"))).when(F.col("heading") == 2, own)
    lined = headed.join(formats, ["file", "list"], "left").withColumn("mark", mark)
    if "bullets" in tables:
        lined = lined.join(tables["bullets"].select("file", F.col("id").alias("numbering"), F.col("mark").alias("bullet")), ["file", "numbering"], "left")
    else:
        lined = lined.withColumn("bullet", F.lit(None).cast("string"))
    level, mark, t, kind = F.col("level"), F.coalesce("mark", F.lit("")), F.col("text"), F.col("heading")
    line = F.when((kind == 1) & (level <= 7), r.outline_number(level, mark, t)).when((kind == 2) & (level <= 7), r.list_item(level, mark, t)).when(kind == 3, r.bullet(F.col("bullet"), t)).otherwise(r.paragraph(t, F.col("para_shape")))
    return lined.select("file", "path", "section", "container", "page_break", t.alias("plain"), F.when(t == "", F.lit("")).otherwise(line).alias("line"))


def cell_fills(tables: dict[str, DataFrame]) -> DataFrame:
    """file, path, fill_id of each cell: of the last zone that holds it, else its own, else its table's."""
    cells = tables["cells"].join(tables["tables"].select("file", F.col("path").alias("table"), F.col("border_fill").alias("table_fill")), ["file", "table"], "left").withColumn("cell_fill", F.col("border_fill"))
    zones = tables["zones"].select("file", F.col("path").alias("table"), F.col("ord").alias("zone_ord"), "left", "top", "right", "bottom", F.col("fill").alias("zone_fill"))
    return zone_fill(cells, zones, ["file", "table"]).select("file", "path", F.col("fill").alias("fill_id"))


def border_css(side: str) -> Column:
    """A side's border as a style rule: no line is none; other lines are solid, dashed, dotted or double."""
    line = F.col(f"{side}_line")
    style = F.when(line == 2, F.lit("dotted")).when(line.isin(3, 4, 5, 6), F.lit("dashed")).when(line.isin(8, 9, 10, 11), F.lit("double")).otherwise(F.lit("solid"))
    rule = lit(V.border_mm_text(F.col(f"{side}_width")), " ", style, " ", V.colour_hex(F.coalesce(F.col(f"{side}_colour"), F.lit(0))))
    return F.when(line.isNull(), F.lit(None).cast("string")).otherwise(lit(f"border-{side}:", F.when(line == 0, F.lit("none")).otherwise(rule)))


def cell_styles(tables: dict[str, DataFrame]) -> DataFrame:
    """file, path, style of each cell: borders and background of its border fill, and its width."""
    fills = tables["border_fills"].withColumn("css", F.concat_ws(";", *(border_css(s) for s in ("left", "right", "top", "bottom")), F.when(F.col("fill").isNotNull() & (F.col("fill") != 0xFFFFFFFF), lit("background-color:", V.colour_hex(F.col("fill"))))))
    found = cell_fills(tables).join(fills.select("file", F.col("id").alias("fill_id"), "css"), ["file", "fill_id"], "left").join(tables["cells"].select("file", "path", "width"), ["file", "path"])
    width = F.when(F.col("width") > 0, lit("width:", F.format_string("%.1f", F.col("width") / 100.0), "pt"))
    return found.select("file", "path", F.concat_ws(";", F.when(F.col("css") != "", F.col("css")), width).alias("style"))


def table_texts(tables: dict[str, DataFrame], lines: DataFrame, r: Renderer) -> DataFrame:
    """file, table, text of every table, from the lines of its cells."""
    inner = lines.groupBy("file", F.col("container").alias("path")).agg(ordered(["path"], "line", r.cell_line).alias("text"))
    cells = tables["cells"].join(inner, ["file", "path"], "left").na.fill({"text": ""})
    if r.name == "html" and all(t in tables for t in ("border_fills", "tables", "zones")):
        cells = cells.join(cell_styles(tables), ["file", "path"], "left")
    else:
        cells = cells.withColumn("style", F.lit(None).cast("string"))
    return r.table(cells.select("file", "table", "row", "col", "row_span", "col_span", "style", r.cell(F.col("text")).alias("text")), ["file", "table"])


def without_repeated_boxes(placed: DataFrame) -> DataFrame:
    """placed without text boxes whose text a cell of the same paragraph's tables holds. Texts meet by their digest."""
    same = Window.partitionBy("file", "owner", F.xxhash64(F.trim("plain")), F.sha2(F.trim("plain"), 256))
    known = F.max(F.when(F.col("in_cell"), 1).otherwise(0)).over(same)
    return placed.withColumn("known", known).where(~((F.coalesce(F.col("held_by"), F.lit("")) == "gso ") & (F.col("known") == 1) & ~F.col("in_cell"))).drop("known")


#: Containers of cells, by the end of their path.
CELL = "\\.r[0-9]{3,}\\.k[0-9]{3,}$"


def document_lines(tables: dict[str, DataFrame], r: Renderer) -> DataFrame:
    """file, part, path, sub, place, inner, line: headers, body, footers, footnotes and endnotes, each in document order.

    Tables follow their paragraph, with captions above or below; paragraphs of cells are in their tables; notes are numbered; breaks of sections and pages are rules, never two in a row."""
    lines = paragraph_lines(tables, r)
    numbers = note_numbers(tables["controls"]).select("file", F.col("path").alias("control"), "n")
    controls = tables["controls"].select("file", F.col("path").alias("control"), F.col("kind").alias("held_by")).join(numbers, ["file", "control"], "left")
    owner = F.regexp_extract("container", "^(.*\\.c[0-9]+)\\.", 1)
    placed = lines.withColumn("control", owner).join(controls, ["file", "control"], "left").where(~F.coalesce(F.col("held_by").isin(*HIDDEN), F.lit(False)))
    placed = placed.withColumn("owner", F.regexp_extract("control", "^(.*)\\.c[0-9]+$", 1)).withColumn("in_cell", F.col("container").rlike(CELL))
    part = F.coalesce(*(F.when(F.col("held_by") == k, F.lit(v)) for k, v in PLACES.items()), F.lit(1))
    own = without_repeated_boxes(placed).where("not in_cell").withColumn("part", part)
    back = F.when(F.col("part") == 3, r.footnote_back(F.col("n"), F.col("line"))).when(F.col("part") == 4, r.endnote_back(F.col("n"), F.col("line"))).otherwise(F.col("line"))
    above = F.lit(False)
    if "captions" in tables:
        own = own.join(tables["captions"].select("file", F.col("path").alias("container"), "side"), ["file", "container"], "left")
        back = F.when(F.col("side").isNotNull(), r.caption(F.col("line"))).otherwise(back)
        above = F.coalesce(F.col("side") == "top", F.lit(False))
    held = F.coalesce(F.col("held_by") == "tbl ", F.lit(False))
    asked = F.coalesce(F.col("page_break"), F.lit(False)) & ~F.col("container").contains(".")
    rows = own.select("file", "part", F.when(held, F.col("owner")).otherwise(F.col("path")).alias("path"), F.when(held, F.col("control")).otherwise(F.lit("")).alias("sub"), F.when(~held, F.lit(1)).when(above, F.lit(0)).otherwise(F.lit(2)).alias("place"), F.col("path").alias("inner"), back.alias("line"), F.col("line").alias("bare"), asked.alias("asked")).where("bare <> ''").drop("bare")
    texts = table_texts(tables, lines, r).select("file", F.regexp_extract("table", "^(.*)\\.c[0-9]+$", 1).alias("path"), "table", F.col("text").alias("line"))
    in_cell = texts.where(~F.regexp_extract("path", "^(.*)\\.[0-9]+$", 1).rlike(CELL))
    rows = rows.unionByName(in_cell.select("file", F.lit(1).alias("part"), "path", F.col("table").alias("sub"), F.lit(1).alias("place"), F.lit("").alias("inner"), "line", F.lit(False).alias("asked")).where("line <> ''"))
    # A rule stands before the first line of a section and of a paragraph that asks for a new page, where a line that is no rule stands before.
    order = Window.partitionBy("file", "part").orderBy("path", "sub", "place", "inner")
    section, before = F.substring_index("path", ".", 1), F.lag("line").over(order)
    fresh = (F.col("part") == 1) & before.isNotNull() & ~before.startswith(r.page_break()) & (F.col("asked") | (section != F.lag(section).over(order)))
    return rows.withColumn("line", F.when(fresh, F.concat(F.lit(r.page_break() + r.block), F.col("line"))).otherwise(F.col("line"))).drop("asked")


def document_text(tables: dict[str, DataFrame], html: bool = False, options: Options | None = None, name: str | None = None) -> DataFrame:
    """file, text of each document in a renderer of the registry: Markdown, or HTML, or the one named."""
    r = renderer(name or ("html" if html else "markdown"), options)
    body = document_lines(tables, r).groupBy("file").agg(r.document_footer(ordered(["part", "path", "sub", "place", "inner"], "line", r.block)).alias("text"))
    if (r.options.include_version or r.options.include_page_info) and "headers" in tables and "pages" in tables:
        sheet = tables["pages"].groupBy("file").agg(F.min_by(F.struct("width", "height"), "section").alias("s"))
        top = tables["headers"].join(sheet, "file", "left").select("file", r.document_header(F.col("version"), F.col("s.width"), F.col("s.height")).alias("top"))
        body = body.join(top, "file", "left").select("file", F.when(F.coalesce("top", F.lit("")) == "", F.col("text")).otherwise(F.concat("top", F.lit(r.block), "text")).alias("text"))
    return body.select("file", r.document(F.col("text")).alias("text"))


def document_css(tables: dict[str, DataFrame], prefix: str = "") -> DataFrame:
    """file, css: one rule for each character shape and paragraph shape, in the order of their ids."""
    p = prefix
    colour = F.when(F.col("colour") != 0, lit("color: rgb(", *(x for at, tail in ((0, ","), (8, ","), (16, ")")) for x in (V.field(F.col("colour"), at, 8).cast("string"), tail))))
    shade = F.when(F.col("shade").isNotNull() & ~F.col("shade").isin(0, 0xFFFFFF, 0xFFFFFFFF), lit("background-color: ", V.colour_hex(F.col("shade"))))
    props = F.concat_ws("; ", F.when(F.col("height") != 0, lit("font-size: ", F.format_string("%.1f", F.col("height") / 100.0), "pt")), F.when(F.col("bold"), F.lit("font-weight: bold")), F.when(F.col("italic"), F.lit("font-style: italic")), colour, shade, F.when(F.col("face").isNotNull(), lit("font-family: '", X.font_escape(F.col("face")), "'")))
    chars = tables["char_shapes"]
    faces = tables["fonts"].select("file", F.col("id").alias("font"), F.col("name").alias("face")).groupBy("file", "font").agg(F.min("face").alias("face")) if "fonts" in tables else None
    chars = chars.join(faces, ["file", "font"], "left") if faces is not None else chars.withColumn("face", F.lit(None).cast("string"))
    one = chars.withColumn("props", props).where("props <> ''").select("file", F.lit(1).alias("part"), "id", F.concat(F.lit(f".{p}cs-"), F.col("id").cast("string"), F.lit(" { "), F.col("props"), F.lit(" }")).alias("rule"))
    align = F.get(F.array(*map(F.lit, ("justify", "left", "right", "center"))), F.col("align").cast("int"))
    mm = lambda c: V.mm_text(V.unit_to_mm(F.col(c)))
    margins = [F.when(F.col(c) != 0, lit(f"{css}: ", mm(c))) for c, css in (("left", "margin-left"), ("right", "margin-right"), ("indent", "text-indent"), ("before", "margin-top"), ("after", "margin-bottom"))]
    rules = F.concat_ws("; ", F.when(align.isNotNull(), lit("text-align: ", align)), *margins)
    two = tables["para_shapes"].withColumn("rules", rules).where("rules <> ''").select("file", F.lit(2).alias("part"), "id", F.concat(F.lit(f".{p}ps-"), F.col("id").cast("string"), F.lit(" { "), F.col("rules"), F.lit(" }")).alias("rule"))
    return one.unionByName(two).groupBy("file").agg(F.concat(F.lit(f".{p}table {{ border-collapse: collapse }}\n"), ordered(["part", "id"], "rule", "\n")).alias("css"))


def header_json(headers: DataFrame) -> DataFrame:
    """file, json: version, format, and the names of the flags that are set."""
    flags = F.split(V.names_of_bits(F.col("flags"), dict(enumerate(V.DOCUMENT_FLAGS))), ",")
    licence = F.split(V.names_of_bits(F.col("license_flags"), dict(enumerate(V.LICENSE_FLAGS))), ",")
    named = lambda c: F.filter(c, lambda x: x != "")
    return headers.select("file", F.to_json(F.struct("version", "format", named(flags).alias("document_flags"), named(licence).alias("license_flags"))).alias("json"))


def rows_of(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """file, and the table's rows of each file as an ordered array."""
    own = [c for c in table.columns if c != "file"]
    first = [*order, *(c for c in own if c not in order)]
    return table.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))


def document_json(tables: dict[str, DataFrame], pretty: bool = False) -> DataFrame:
    """file, json in one schema for both formats: header, metadata, dimensions, and paragraphs with their runs and controls. Empty fields are left out."""
    runs = tables["runs"].groupBy("file", "path").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "text", "char_shape"))).alias("runs"))
    paras = tables["paragraphs"].join(runs, ["file", "path"], "left")
    if "controls" in tables:
        held = tables["controls"].select("file", F.regexp_extract("path", "^(.*)\\.c[0-9]+$", 1).alias("para"), F.struct("path", "kind", "target", "number", "number_kind").alias("c"))
        paras = paras.join(held.groupBy("file", F.col("para").alias("path")).agg(F.array_sort(F.collect_list("c")).alias("controls")), ["file", "path"], "left")
    own = [c for c in ("path", "section", "para_shape", "style", "page_break", "runs", "controls") if c in paras.columns]
    found = paras.select("file", F.struct(*own).alias("p")).groupBy("file").agg(F.array_sort(F.collect_list("p")).alias("paragraphs"))
    order = {"char_shapes": ["id"], "para_shapes": ["id"], "styles": ["id"], "fonts": ["id"], "numberings": ["id"], "bullets": ["id"], "border_fills": ["id"], "tab_defs": ["id"], "cells": ["path"], "pages": ["section"], "line_segments": ["path", "segment"]}
    for name, by in order.items():
        if name in tables:
            found = found.join(rows_of(tables[name], by, name), "file", "left")
    if "meta" in tables:
        found = found.join(tables["meta"].groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("meta")), "file", "left")
    if "headers" in tables:
        found = found.join(tables["headers"].select("file", F.struct("version", "format").alias("header")), "file", "left")
    return found.select("file", F.to_json(F.struct(*(c for c in found.columns if c != "file")), {"pretty": "true"} if pretty else {}).alias("json"))


def images(binaries: DataFrame, wanted: str | None = None) -> DataFrame:
    """file, id, format, mime, data of the image parts, of one format if wanted."""
    found = binaries.where(F.col("format").isin(*X.MEDIA)).withColumn("mime", X.media_type(F.col("format")))
    return found.where(F.col("format") == wanted.lower()) if wanted else found


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """path and bytes of each file written below a folder that all executors share (a URI or a path). rows: name, data; the last of equal names wins.

    Tasks write files whole and under their final name, so a task that runs again leaves the same files."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        made = set()
        for batch in batches:
            paths, sizes = [], []
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
                path = f"{base.rstrip('/')}/{name}"
                if (above := path.rsplit("/", 1)[0]) not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(path) as out:
                    out.write(data or b"")
                paths.append(path)
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_pydict({"path": paths, "bytes": pa.array(sizes, pa.int64())})

    return rows.select(F.col("name").cast("string").alias("name"), F.col("data").cast("binary").alias("data")).mapInArrow(run, "path string, bytes long")


def image_files(binaries: DataFrame, wanted: str | None = None) -> DataFrame:
    """name, data of every picture: below a folder named for its file, as ID.extension."""
    return images(binaries, wanted).select(F.concat(F.regexp_replace(F.element_at(F.split("file", "/"), -1), "[^\\w.-]", "_"), F.lit("-"), F.substring(F.md5("file"), 1, 8), F.lit("/"), "id", F.lit("."), "format").alias("name"), "data")


def page_files(pages: DataFrame, css: DataFrame) -> DataFrame:
    """name, data of placed pages: one HTML file for each page below a folder named for its document, which share one style sheet."""
    folder = F.concat(F.regexp_replace(F.element_at(F.split("file", "/"), -1), "[^\\w.-]", "_"), F.lit("-"), F.substring(F.md5("file"), 1, 8))
    html = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><link rel="stylesheet" href="style.css"></head><body>'), "html", F.lit("</body></html>"))
    sheets = css.select(F.concat(folder, F.lit("/style.css")).alias("name"), F.col("css").cast("binary").alias("data"))
    return pages.select(F.concat(folder, F.lit("/page-"), F.lpad(F.col("number").cast("string"), 4, "0"), F.lit(".html")).alias("name"), html.cast("binary").alias("data")).unionByName(sheets)
