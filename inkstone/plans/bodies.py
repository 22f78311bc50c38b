"""Whole compound files: dimensions, bodies, headers, metadata, previews, scripts and protected bodies, written from rows byte by byte and read back as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import values as V
from inkstone.operators import inline, layout, render, views
from inkstone.operators.tables import ordered
from inkstone.plans.records import counted, le, one_field, record, units
from inkstone.plans.relations import read, spread
from inkstone.sources import documents, protected
from inkstone.sources.writer import file_header_bytes, to_files


def fields(*pairs: tuple[str, str]) -> Column:
    return F.concat(*(one_field(kind, expression) for kind, expression in pairs))


def rows_by_brand(spark: SparkSession, d: str, data: Column) -> DataFrame:
    """file, hex: the pieces of part's rows, one after the other, for each brand."""
    rows = read(spark, d, "part").withColumn("hex", data)
    return rows.groupBy(F.col("p_brand").alias("file")).agg(ordered(["p_partkey"], "hex", "").alias("hex"))


def compounds(held: DataFrame, streams: dict[str, Column], flags: int | Column = 1) -> DataFrame:
    """Compound files of hexadecimal streams (columns of held); document information and bodies are deflated."""
    head = F.lit(bytearray(file_header_bytes(flags))) if isinstance(flags, int) else flags
    parts = F.create_map(F.lit("FileHeader"), head, *(x for name, hexed in streams.items() for x in (F.lit(name), F.unhex(hexed))))
    return to_files(spread(held, "file"), F.col("file"), parts, compress=("DocInfo", "BodyText"))


def info_record(spark: SparkSession, d: str, tag: int, data: Column, table: str) -> DataFrame:
    return documents.read_table(compounds(rows_by_brand(spark, d, record(tag, 0, data)), {"DocInfo": F.col("hex")}), table)


def doc_char_shapes(spark, d):
    data = fields(*(("u16", "p_size"),) * 7, ("zero", "28"), ("i32", "p_partkey"), ("u32", "p_size % 2 + 2 * (p_partkey % 2) + 4 * (p_size % 4) + 32768 * (p_partkey % 2) + 262144 * (p_size % 8)"), ("zero", "2"), ("u32", "p_partkey"), ("zero", "4"), ("u32", "p_size"), ("zero", "4"), ("u16", "7"))
    return info_record(spark, d, 0x15, data, "char_shapes").select("file", "id", "height", "italic", "bold", "underline", "superscript", "strike", "colour", "font", "shade", "border_fill")


def doc_para_shapes(spark, d):
    data = fields(("u32", "4 * (p_size % 6) + 8388608 * (p_partkey % 4) + 33554432 * (p_size % 7)"), ("i32", "0 - p_partkey"), ("i32", "p_size"), ("i32", "1"), ("i32", "2"), ("i32", "3"), ("i32", "160"), ("u16", "4"), ("u16", "p_size"), ("u16", "5"), ("zero", "16"), ("i32", "130 + p_size"))
    return info_record(spark, d, 0x19, data, "para_shapes")


def doc_styles(spark, d):
    return info_record(spark, d, 0x1A, fields(("s", "p_name"), ("s", "p_type"), ("u8", "0"), ("u8", "1"), ("i16", "1042"), ("u16", "p_size"), ("u16", "3")), "styles")


def doc_fonts(spark, d):
    return info_record(spark, d, 0x13, fields(("u8", "160"), ("s", "p_name"), ("u8", "1"), ("s", "p_type"), ("s", "p_brand")), "fonts").select("file", "id", "name", "substitute", "standard")


def doc_numberings(spark, d):
    level = lambda k: fields(("u32", f"32 * (p_size % 10)"), ("zero", "8"), ("s", f"'^{k}.'"))  # noqa: E731, F541
    data = F.concat(*(level(k) for k in range(1, 8)), fields(*(("u16", "1"),) * 7), fields(*(("u32", "p_size"),) * 7), fields(*(("s", "p_brand"),) * 3))
    found = info_record(spark, d, 0x17, data, "numberings")
    return found.select("file", "id", F.concat_ws("|", "formats").alias("formats"), F.concat_ws("|", F.transform("kinds", lambda x: x.cast("string"))).alias("kinds"), F.get("starts", F.lit(6)).alias("start"))


def doc_bullets(spark, d):
    return info_record(spark, d, 0x18, fields(("zero", "12"), ("u16", "65 + p_size % 26"), ("i32", "p_size % 2")), "bullets")


def doc_border_fills(spark, d):
    data = F.concat(fields(("u16", "p_size")), *(fields(("u8", "p_size % 12"), ("u8", f"(p_size + {k}) % 16"), ("u32", "p_partkey")) for k in range(4)), fields(("zero", "6"), ("u32", "1"), ("u32", "p_partkey * 3"), ("zero", "8")))
    return info_record(spark, d, 0x14, data, "border_fills").select("file", "id", "bits", "left_line", "top_width", "bottom_colour", "fill")


def doc_tab_defs(spark, d):
    return info_record(spark, d, 0x16, fields(("u32", "p_size"), ("u16", "1"), ("u32", "p_partkey"), ("u8", "p_size % 4"), ("u8", "2"), ("zero", "2")), "tab_defs")


def doc_bin_items(spark, d):
    return info_record(spark, d, 0x12, fields(("u16", "1"), ("u16", "p_partkey % 60000"), ("s", "CASE WHEN p_size % 2 = 0 THEN 'PNG' ELSE 'jpg' END")), "bin_items")


def doc_settings(spark, d):
    found = info_record(spark, d, 0x10, fields(("u16", "1"), ("u16", "p_size"), ("u16", "2"), ("u16", "3"), ("u16", "p_partkey % 60000"), ("u16", "5"), ("u16", "6"), ("zero", "12")), "settings")
    return views.start_numbers(found)


def paragraph(level: int, text: Column, shape: str = "0", style: str = "0", split: str = "0", mask: str = "0", changes: Column | None = None, more: Column | None = None) -> Column:
    """A paragraph's records: header, text, changes of style, then what is given."""
    head = record(0x42, level, F.concat(le(F.length(text) / 4, 4), fields(("u32", mask), ("u16", shape), ("u8", style), ("u8", split), ("u16", "1"), ("u16", "0"), ("u16", "0"), ("u32", "0"), ("u16", "0"))))
    return F.concat(head, record(0x43, level + 1, text), record(0x44, level + 1, changes if changes is not None else F.lit("00" * 8)), *([more] if more is not None else []))


def mark(code: int, control: str) -> Column:
    """An eight-unit control mark with its four letters."""
    return F.lit((code.to_bytes(2, "little") + control[::-1].encode() + bytes(8) + code.to_bytes(2, "little")).hex())


def control(level: int, letters: str, *pairs: tuple[str, str]) -> Column:
    return record(0x47, level, F.concat(F.lit(letters[::-1].encode().hex()), *([fields(*pairs)] if pairs else [])))


def body_files(spark: SparkSession, d: str, data: Column, info: Column | None = None) -> DataFrame:
    held = rows_by_brand(spark, d, data)
    return compounds(held, {"DocInfo": info if info is not None else F.lit(""), "BodyText/Section0": F.col("hex")})


def body_paragraphs(spark, d):
    files = body_files(spark, d, paragraph(0, units(F.col("p_name")), "p_size", "3", "p_size % 16", "p_partkey * 4"))
    return documents.read_table(files, "paragraphs")


def styled_paragraph() -> Column:
    """A name, whose style changes after five units; the first is an astral character of two."""
    changes = fields(("u32", "0"), ("u32", "p_size"), ("u32", "5"), ("u32", "p_partkey"))
    lines = F.concat(*(fields(("u32", f"{k} * 4"), ("i32", f"{k} * 1600"), ("i32", "1000"), ("i32", "900"), ("i32", "850"), ("i32", "600"), ("i32", "0"), ("i32", "42520"), ("u32", "65536 * (p_size % 2)")) for k in range(2)))
    return paragraph(0, F.concat(F.lit("3DD800DE"), units(F.col("p_name"))), changes=changes, more=record(0x45, 1, lines))


def body_runs(spark, d):
    return documents.read_table(body_files(spark, d, styled_paragraph()), "runs").select("file", "path", "ord", "text", "char_shape")


def body_line_texts(spark, d):
    t = documents.read_tables(body_files(spark, d, styled_paragraph()), ("runs", "line_segments"))
    return layout.line_texts(t["runs"], t["line_segments"]).select("file", "path", "segment", "top", "height", "text")


def segment_styles(spark, d):
    t = documents.read_tables(body_files(spark, d, styled_paragraph()), ("runs", "line_segments"))
    return layout.segment_styles(t["runs"], t["line_segments"])


def text_boundaries(spark, d):
    t = documents.read_tables(body_files(spark, d, styled_paragraph()), ("runs", "line_segments"))
    return layout.boundaries(t["runs"], t["line_segments"]).select("file", "path", F.concat_ws(",", F.transform("places", lambda x: x.cast("string"))).alias("places"))


def large_lines(spark, d):
    lines = fields(("u32", "0"), ("i32", "0"), ("i32", "p_size * 100"), ("zero", "24"))
    return views.large_lines(documents.read_table(body_files(spark, d, paragraph(0, units(F.col("p_name")), more=record(0x45, 1, lines))), "line_segments"))


def control_pieces(spark, d):
    """Marks and text around them: tab with its width, an inline mark, a reserved code of eight units, single marks."""
    text = F.concat(units(F.lit("a")), F.lit("0900"), le(F.col("p_size"), 4), F.lit("00" * 8 + "0900"), mark(26, "abcd"), F.lit("1800"), units(F.col("p_brand")), F.lit("0D00"))
    return documents.read_table(body_files(spark, d, paragraph(0, text)), "runs").select("file", "path", "ord", "kind", "text")


def cells_of(part: int) -> Column:
    """A list header of a cell and its paragraph: the row's second cell holds the size."""
    head = record(0x48, 2, fields(("u16", "1"), ("zero", "6"), ("u16", str(part)), ("u16", "0"), ("u16", "1"), ("u16", "1"), ("u32", "p_size * 100"), ("u32", "p_partkey"), ("zero", "8"), ("u16", "p_size % 3")))
    return F.concat(head, paragraph(2, units(F.col("p_name") if part == 0 else F.col("p_size").cast("string"))))


def table_paragraph() -> Column:
    zones = fields(("u16", "1"), ("u16", "0"), ("u16", "0"), ("u16", "0"), ("u16", "0"), ("u16", "2 * (p_partkey % 2)"))
    shape = record(0x4D, 2, F.concat(fields(("u32", "0"), ("u16", "1"), ("u16", "2"), ("zero", "10"), ("u16", "2"), ("u16", "3")), zones))
    return paragraph(0, F.concat(mark(11, "tbl "), units(F.lit("T"))), more=F.concat(control(1, "tbl ", ("zero", "42")), shape, cells_of(0), cells_of(1)))


def body_cells(spark, d):
    return documents.read_table(body_files(spark, d, table_paragraph()), "cells").select("file", "path", "table", "row", "col", "row_span", "width", "height", "border_fill")


def body_tables(spark, d):
    return documents.read_table(body_files(spark, d, table_paragraph()), "tables")


def body_zones(spark, d):
    return documents.read_table(body_files(spark, d, table_paragraph()), "zones")


def cell_fills(spark, d):
    t = documents.read_tables(body_files(spark, d, table_paragraph()), ("cells", "tables", "zones"))
    return render.cell_fills(t)


def table_sizes(spark, d):
    return views.table_sizes(documents.read_table(body_files(spark, d, table_paragraph()), "cells"))


def border_info() -> Column:
    side = lambda line, width: F.concat(le(F.lit(line), 1), le(F.lit(width), 1), F.lit("FF000000"))
    fill = lambda *sides: record(0x14, 0, F.concat(F.lit("0000"), *(side(*s) for s in sides), F.lit("00" * 10)))
    return F.concat(fill((1, 5), (1, 5), (1, 5), (1, 5)), fill((1, 1), (0, 0), (2, 7), (1, 0)), fill((1, 9), (1, 2), (1, 2), (1, 2)))


def table_borders(spark, d):
    t = documents.read_tables(body_files(spark, d, table_paragraph(), border_info()), ("cells", "tables", "zones", "border_fills"))
    return views.table_borders(t)


def table_svg(spark, d):
    t = documents.read_tables(body_files(spark, d, table_paragraph(), border_info()), ("cells", "tables", "zones", "border_fills"))
    return views.table_svg(t).select("file", "table", (F.size(F.split("svg", "<path")) - 1).cast("long").alias("paths"), F.regexp_extract("svg", '<path d="([^"]*)"', 1).alias("first"))


def body_markdown(spark, d):
    """Compound files to Markdown: a table after its paragraph."""
    t = documents.read_tables(body_files(spark, d, table_paragraph()), render.TEXT_TABLES)
    return render.document_text(t).select("file", F.col("text").alias("markdown"))


def compound_json(spark, d):
    """The one JSON schema, of a compound file: runs, controls, cells."""
    held = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), table_paragraph().alias("hex"))
    files = compounds(held, {"DocInfo": F.lit(""), "BodyText/Section0": F.col("hex")})
    t = documents.read_tables(files, ("headers", "runs", "paragraphs", "cells"))
    value = lambda path: F.get_json_object("json", f"$.{path}")
    return render.document_json(t).select(F.col("file").cast("long").alias("p_partkey"), value("header.format").alias("format"), value("paragraphs[0].runs[1].text").alias("text"), value("paragraphs[1].runs[0].text").alias("first"), value("cells[1].col").cast("long").alias("col"), value("cells[1].height").cast("long").alias("height"), value("paragraphs[0].runs[0].control").alias("left_out"))


def section_paragraph() -> Column:
    page = record(0x49, 2, fields(("u32", "59528"), ("u32", "84188"), ("u32", "p_size * 100"), ("u32", "8504"), ("u32", "5668"), ("u32", "4252"), ("u32", "1000"), ("u32", "p_partkey"), ("u32", "283"), ("u32", "p_size % 2")))
    section = control(1, "secd", ("zero", "14"), ("u16", "p_size % 3"), ("zero", "10"))
    columns = control(1, "cold", ("u16", "p_size % 3 + 4 * (p_partkey % 5) + 4096"), ("u16", "p_size"))
    notes = record(0x4A, 2, fields(("u32", "1024 * (p_size % 3)"), ("zero", "6"), ("u16", "p_size"), ("zero", "14")))
    return paragraph(0, F.concat(mark(2, "secd"), mark(2, "cold"), units(F.lit("s"))), more=F.concat(section, page, notes, columns))


def first_rows(spark: SparkSession, d: str, data: Column) -> DataFrame:
    """A compound file for each row of part."""
    return compounds(read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), data.alias("hex")), {"DocInfo": F.lit(""), "BodyText/Section0": F.col("hex")})


def page_geometry(spark, d):
    return views.page_geometry(documents.read_table(first_rows(spark, d, section_paragraph()), "pages"))


def column_definitions(spark, d):
    return views.column_definitions(documents.read_table(first_rows(spark, d, section_paragraph()), "controls"))


def outline_ids(spark, d):
    return views.outline_ids(documents.read_table(first_rows(spark, d, section_paragraph()), "controls"))


def note_shapes(spark, d):
    return documents.read_table(first_rows(spark, d, section_paragraph()), "note_shapes").select("file", "section", "kind", "restart", "start")


def numbered_paragraph() -> Column:
    """An automatic number of tables; every seventh part sets the next one first."""
    text = F.concat(mark(21, "newn"), mark(18, "autn"), units(F.lit("x")))
    fresh = F.concat(control(1, "newn", ("u32", "CASE WHEN p_size % 7 = 0 THEN 4 ELSE 3 END"), ("u16", "p_size"), ("zero", "2")), control(1, "autn", ("u32", "4 + 16 * (p_size % 5)"), ("u16", "0"), ("zero", "6")))
    return paragraph(0, text, more=fresh)


def automatic_numbers(spark, d):
    info = record(0x10, 0, fields(("u16", "1"), ("zero", "8"), ("u16", "5"), ("zero", "14")))
    t = documents.read_tables(body_files(spark, d, numbered_paragraph(), info), ("controls", "settings", "note_shapes"))
    found = inline.automatic_numbers(t["controls"], t["settings"], t["note_shapes"])
    return found.where("number_kind = 'table'").select("file", "path", "n", "shown")


def header_paragraph() -> Column:
    inner = F.concat(record(0x48, 2, F.lit("00" * 8)), paragraph(2, units(F.col("p_brand"))))
    return paragraph(0, F.concat(mark(16, "head"), units(F.col("p_name"))), mask="CASE WHEN p_size % 2 = 0 THEN 65536 ELSE 0 END", more=F.concat(control(1, "head", ("u32", "p_size % 3"), ("zero", "10")), inner))


def marked_paragraphs(spark, d):
    """The paragraphs whose control mask tells of headers, footers or notes: a filter on the mask alone."""
    return views.with_marks(documents.read_table(body_files(spark, d, header_paragraph()), "paragraphs")).select("file", "path", "mask")


def held_paragraphs(spark, d):
    t = documents.read_tables(body_files(spark, d, header_paragraph()), ("paragraphs", "controls"))
    return views.held_by_controls(t["paragraphs"], t["controls"]).select("file", "path", "container")


def file_headers(spark, d):
    orders = read(spark, d, "orders")
    head = F.unhex(F.concat(F.lit(b"HWP Document File".ljust(32, b"\0").hex()), le(F.lit(0x05000000) + F.col("o_orderkey"), 4), le(F.col("o_orderkey") * 16, 4), le(F.col("o_orderkey") % 8, 4), F.lit("00" * 212)))
    files = to_files(orders, F.col("o_orderkey"), F.create_map(F.lit("FileHeader"), head))
    return render.header_json(documents.read_table(files, "headers")).select(F.col("file").cast("long").alias("o_orderkey"), "json")


def summary_hex(title: Column, ticks: Column) -> Column:
    """A property set of a code page, a title and a time."""
    text = F.concat(units(title), F.lit("0000"))
    n = F.length(text) / 4
    padded = F.concat(text, F.repeat(F.lit("00"), F.pmod(-(F.length(text) / 2).cast("int"), F.lit(4))))
    page, name = F.concat(F.lit("02000000"), F.lit("B0040000")), F.concat(F.lit("1F000000"), le(n, 4), padded)
    time = F.concat(F.lit("40000000"), le(F.pmod(ticks, F.lit(1 << 32)), 4), le(F.floor(ticks / F.lit(1 << 32)), 4))
    first = 8 + 3 * 8
    places = F.concat(le(F.lit(1), 4), le(F.lit(first), 4), le(F.lit(2), 4), le(F.lit(first + 8), 4), le(F.lit(12), 4), le(F.lit(first + 8) + F.length(name) / 2, 4))
    return F.concat(F.lit("FEFF0000" + "00" * 20 + "01000000" + "00" * 16 + "30000000"), le(F.lit(0), 4), le(F.lit(3), 4), places, page, name, time)


def document_metadata(spark, d):
    """Summary information of a file for each event: its type as title, its time as creation time."""
    events = read(spark, d, "events")
    ticks = V.filetime(F.col("ts").cast("timestamp"))
    parts = F.create_map(F.lit("FileHeader"), F.lit(bytearray(file_header_bytes())), F.lit("\x05HwpSummaryInformation"), F.unhex(summary_hex(F.col("event_type"), ticks)))
    meta = documents.read_table(to_files(events, F.col("event_id"), parts), "meta")
    return meta.groupBy(F.col("file").cast("long").alias("event_id")).agg(F.max(F.when(F.col("key") == "title", F.col("value"))).alias("title"), F.max(F.when(F.col("key") == "created", F.col("value"))).alias("created"))


def metadata_columns(spark, d):
    events = read(spark, d, "events")
    parts = F.create_map(F.lit("FileHeader"), F.lit(bytearray(file_header_bytes())), F.lit("\x05HwpSummaryInformation"), F.unhex(summary_hex(F.col("event_type"), F.lit(0).cast("long") + 116444736000000000)))
    return views.metadata(documents.read_table(to_files(events, F.col("event_id"), parts), "meta")).select(F.col("file").cast("long").alias("event_id"), "title", "creator")


def previews(spark, d):
    image = F.element_at(F.array(*(F.lit(bytearray(x)) for x in (b"BMxx", b"GIF89a..", b"\x89PNG"))), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    parts = F.create_map(F.lit("FileHeader"), F.lit(bytearray(file_header_bytes())), F.lit("PrvText"), F.unhex(units(F.col("url"))), F.lit("PrvImage"), image)
    found = documents.read_table(to_files(read(spark, d, "pages"), F.col("page_id"), parts), "preview")
    from inkstone.functions.text import preview_format

    return found.select(F.col("file").cast("long").alias("page_id"), "text", preview_format(F.unbase64("image")).alias("format"))


def embedded_files(spark, d):
    """Binary parts in the storage of pictures, deflated or as they are; the extension names the type."""
    name = F.concat(F.lit("BinData/BIN"), F.lpad(F.hex(F.pmod("page_id", F.lit(60000))), 4, "0"), F.lit("."), F.when(F.pmod("page_id", F.lit(2)) == 0, F.lit("png")).otherwise(F.lit("txt")))
    parts = F.map_from_arrays(F.array(F.lit("FileHeader"), name), F.array(F.lit(bytearray(file_header_bytes(1))), F.col("html").cast("binary")))
    found = documents.read_table(to_files(read(spark, d, "pages"), F.col("page_id"), parts), "binaries")
    return found.select(F.col("file").cast("long").alias("page_id"), "id", "format", F.md5("data").alias("digest"))


def picture_files(spark, d):
    """Pictures alone, with their media type."""
    name = F.concat(F.lit("BinData/BIN0001."), F.element_at(F.array(*map(F.lit, ("png", "jpg", "txt"))), (F.pmod("page_id", F.lit(3)) + 1).cast("int")))
    parts = F.map_from_arrays(F.array(F.lit("FileHeader"), name), F.array(F.lit(bytearray(file_header_bytes())), F.col("url").cast("binary")))
    found = render.images(documents.read_table(to_files(read(spark, d, "pages"), F.col("page_id"), parts), "binaries"))
    return found.select(F.col("file").cast("long").alias("page_id"), "mime", F.octet_length("data").cast("long").alias("bytes"))


def scripts(spark, d):
    source = F.concat(counted(F.col("url"), 4), counted(F.concat(F.lit("f("), F.col("page_id").cast("string"), F.lit(")")), 4), F.lit("00" * 8 + "FFFFFFFF"))
    parts = F.create_map(F.lit("FileHeader"), F.lit(bytearray(file_header_bytes())), F.lit("Scripts/JScriptVersion"), F.unhex(F.concat(le(F.lit(1), 4), le(F.col("page_id"), 4))), F.lit("Scripts/DefaultJScript"), F.unhex(source))
    found = documents.read_table(to_files(read(spark, d, "pages"), F.col("page_id"), parts), "scripts")
    return found.select(F.col("file").cast("long").alias("page_id"), "high", "low", "head", "source")


def templates(spark, d):
    parts = F.create_map(F.lit("FileHeader"), F.lit(bytearray(file_header_bytes(32))), F.lit("XMLTemplate/_SchemaName"), F.unhex(counted(F.col("url"), 4)), F.lit("XMLTemplate/Schema"), F.unhex(counted(F.lit("<schema/>"), 4)))
    found = documents.read_table(to_files(read(spark, d, "pages"), F.col("page_id"), parts), "templates")
    return found.select(F.col("file").cast("long").alias("page_id"), "schema_name", "schema", "instance")


def protected_bodies(spark, d):
    """A body sealed with the key that its own seed hides, and opened again."""
    seed = F.col("n_nationkey").cast("long") + 1
    key_bytes = F.slice(V.key_stream(seed), (5 + seed.bitwiseAND(15)).cast("int"), 16)
    key = F.unhex(F.array_join(F.transform(key_bytes, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    plain = F.unhex(F.rpad(paragraph(0, units(F.col("n_name"))), 160, "0"))
    sealed = F.substring(F.aes_encrypt(plain, key, F.lit("ECB"), F.lit("PKCS")), 1, 80)
    view = F.concat(F.unhex(record(0x1C, 0, F.concat(le(seed, 4), F.lit("00" * 252)))), sealed)
    parts = F.create_map(F.lit("FileHeader"), F.lit(bytearray(file_header_bytes(4))), F.lit("ViewText/Section0"), view)
    found = protected.read_protected(to_files(read(spark, d, "nation"), F.col("n_nationkey"), parts), "runs")
    return found.where("text <> ''").select(F.col("file").cast("long").alias("n_nationkey"), "text")


def key_stream_bytes(spark, d):
    n = read(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("seed"), F.posexplode(V.key_stream(F.col("n_nationkey").cast("long")))).select("seed", F.col("pos").cast("long").alias("place"), F.col("col").alias("value"))


def batch_errors(spark, d):
    """What is wrong with broken files: every third one is cut off, every fifth isn't a document, every seventh is locked."""
    k = F.col("page_id")
    flags = F.when(F.pmod(k, F.lit(7)) == 0, F.lit(bytearray(file_header_bytes(2)))).otherwise(F.lit(bytearray(file_header_bytes())))
    files = to_files(read(spark, d, "pages"), k, F.create_map(F.lit("FileHeader"), flags, F.lit("DocInfo"), F.lit(bytearray(b""))))
    n = F.col("path").cast("long")
    broken = files.withColumn("content", F.when(F.pmod(n, F.lit(5)) == 0, F.lit(bytearray(b"plain"))).when(F.pmod(n, F.lit(3)) == 0, F.substring("content", 1, 600)).otherwise(F.col("content")))
    return documents.read_table(broken, "errors").where(F.col("part").isin("file", "char_shapes")).select(F.col("file").cast("long").alias("page_id"), "part", "kind")


def shape_sizes(spark, d):
    """The drawn objects of each file: how many, the tallest, the widest."""
    shape = record(0x4C, 1, fields(("hex", "63657224"), ("hex", "63657224"), ("zero", "12"), ("zero", "8"), ("u32", "p_partkey"), ("u32", "p_size * 100"), ("zero", "16"), ("zero", "48")))
    return views.shape_sizes(documents.read_table(body_files(spark, d, shape), "records"))


def field_parameters(spark, d):
    """The parameters of a field, in their order."""
    xml = F.concat(F.lit('<sec><parameters><integerParam name="n">'), F.col("page_id").cast("string"), F.lit('</integerParam><stringParam name="Command">'), F.regexp_replace("url", "&", "&amp;"), F.lit("</stringParam></parameters></sec>"))
    files = to_files(read(spark, d, "pages"), F.col("page_id"), F.create_map(F.lit("Contents/section0.xml"), xml.cast("binary")), "package")
    found = documents.read_table(files, "elements").where("name = 'parameters'")
    value = lambda path: F.get_json_object("fields", f"$.{path}")
    return found.select(F.col("file").cast("long").alias("page_id"), value("integerParam[0].name").alias("first"), value("integerParam[0].text").cast("long").alias("n"), value("stringParam[0].name").alias("second"), value("stringParam[0].text").alias("command"))


def sql_functions(spark, d):
    """The registered expressions in SQL."""
    from inkstone.functions.register import register

    register(spark)
    read(spark, d, "part").createOrReplaceTempView("inkstone_parts")
    return spark.sql("SELECT p_partkey, inkstone_roman(p_partkey) AS roman, inkstone_colour_hex(p_partkey) AS colour, inkstone_version_text(p_partkey) AS version, inkstone_html_escape(concat('<', p_name, '>')) AS name, inkstone_control_class(CAST(p_size AS BIGINT)) AS kind FROM inkstone_parts")


def sql_numbers(inner: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) {inner}"


def catalog() -> dict:
    path = "'0000.' || printf('%06d', k - 1)"
    n = "FROM " + sql_numbers("t")
    ident = f"SELECT p_brand AS file, k - 1 AS id"
    one = "SELECT p_brand AS file, k AS id"
    first_id = "CAST(p_partkey AS VARCHAR) AS file, CAST(0 AS BIGINT) AS section"
    cell = f"SELECT p_brand AS file, {path} || '.c000.r000.k' || printf('%03d', c) AS path, {path} || '.c000' AS \"table\", CAST(0 AS BIGINT) AS \"row\", CAST(c AS BIGINT) AS col, CAST(1 AS BIGINT) AS row_span, CAST(p_size * 100 AS BIGINT) AS width, p_partkey AS height, CAST(p_size % 3 AS BIGINT) AS border_fill {n}, (SELECT unnest([0, 1]) AS c)"
    # Fill of a cell: the zone's (first column, fill 2 for odd keys), else its own, else the table's (3).
    fill = "CASE WHEN c = 0 AND p_partkey % 2 = 1 THEN 2 WHEN p_size % 3 <> 0 THEN p_size % 3 ELSE 3 END"
    name16 = "(chr(128512) || p_name)"
    stream = """WITH RECURSIVE s(seed, p, state, value, n) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(0 AS BIGINT), CAST(n_nationkey AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM nation
UNION ALL SELECT seed, p + n, two, (one >> 16) & 255, ((two >> 16) & 15) + 1 FROM (SELECT *, (one * 214013 + 2531011) & 2147483647 AS two FROM (SELECT *, (state * 214013 + 2531011) & 2147483647 AS one FROM s)) WHERE p + n < 256)
SELECT seed, place, value FROM (SELECT seed, unnest(range(p, p + n)) AS place, value FROM s WHERE n > 0) WHERE place < 256"""
    return {
        "doc_char_shapes": (doc_char_shapes, f"{ident}, p_partkey AS height, p_size % 2 = 1 AS italic, p_partkey % 2 = 1 AS bold, CAST(p_size % 4 AS BIGINT) AS underline, p_partkey % 2 = 1 AS superscript, CAST(p_size % 8 AS BIGINT) AS strike, p_partkey AS colour, CAST(p_size AS BIGINT) AS font, CAST(p_size AS BIGINT) AS shade, CAST(7 AS BIGINT) AS border_fill {n}"),
        "doc_para_shapes": (doc_para_shapes, f"{ident}, CAST(p_size % 6 AS BIGINT) AS align, p_partkey % 4 AS heading, CAST(p_size % 7 + 1 AS BIGINT) AS level, -p_partkey AS \"left\", CAST(p_size AS BIGINT) AS \"right\", CAST(1 AS BIGINT) AS indent, CAST(2 AS BIGINT) AS before, CAST(3 AS BIGINT) AS after, CAST(130 + p_size AS BIGINT) AS spacing, CAST(p_size AS BIGINT) AS numbering, CAST(4 AS BIGINT) AS tab_def, CAST(5 AS BIGINT) AS border_fill {n}"),
        "doc_styles": (doc_styles, f"{ident}, p_name AS name, p_type AS english, CAST(p_size AS BIGINT) AS para_shape, CAST(3 AS BIGINT) AS char_shape {n}"),
        "doc_fonts": (doc_fonts, f"{ident}, p_name AS name, p_type AS substitute, p_brand AS standard {n}"),
        "doc_numberings": (doc_numberings, f"{one}, '^1.|^2.|^3.|^4.|^5.|^6.|^7.|' || p_brand || '|' || p_brand || '|' || p_brand AS formats, repeat(kind || '|', 6) || kind AS kinds, CAST(p_size AS BIGINT) AS start FROM (SELECT *, CASE p_size % 10 WHEN 6 THEN '0' WHEN 7 THEN '0' WHEN 9 THEN '10' ELSE CAST(p_size % 10 AS VARCHAR) END AS kind {n})"),
        "doc_bullets": (doc_bullets, f"{one}, chr(CAST(65 + p_size % 26 AS INTEGER)) AS mark, CAST(p_size % 2 AS BIGINT) AS image {n}"),
        "doc_border_fills": (doc_border_fills, f"{one}, CAST(p_size AS BIGINT) AS bits, CAST(p_size % 12 AS BIGINT) AS left_line, CAST((p_size + 2) % 16 AS BIGINT) AS top_width, p_partkey AS bottom_colour, p_partkey * 3 AS fill {n}"),
        "doc_tab_defs": (doc_tab_defs, f"{ident}, CAST(p_size AS BIGINT) AS bits, '[{{\"position\": ' || p_partkey || ', \"kind\": ' || p_size % 4 || ', \"fill\": 2}}]' AS tabs {n}"),
        "doc_bin_items": (doc_bin_items, "SELECT p_brand AS file, printf('BIN%04X', p_partkey % 60000) AS id, CASE WHEN p_size % 2 = 0 THEN 'png' ELSE 'jpg' END AS format FROM part"),
        "doc_settings": (doc_settings, "SELECT p_brand AS file, CAST(p_size AS BIGINT) AS page_start, CAST(2 AS BIGINT) AS footnote_start, CAST(3 AS BIGINT) AS endnote_start, p_partkey % 60000 AS picture_start, CAST(5 AS BIGINT) AS table_start, CAST(6 AS BIGINT) AS equation_start FROM part"),
        "body_paragraphs": (body_paragraphs, f"SELECT p_brand AS file, {path} AS path, CAST(0 AS BIGINT) AS section, '0000' AS container, CAST(p_size AS BIGINT) AS para_shape, CAST(3 AS BIGINT) AS style, (p_size // 4) % 2 = 1 AS page_break, (p_size // 8) % 2 = 1 AS column_break, p_partkey * 4 AS mask {n}"),
        "body_runs": (body_runs, f"SELECT p_brand AS file, {path} AS path, CAST(o AS BIGINT) AS ord, CASE o WHEN 0 THEN substring({name16}, 1, 4) ELSE substring({name16}, 5) END AS text, CASE o WHEN 0 THEN p_size ELSE p_partkey END AS char_shape {n}, (SELECT unnest([0, 1]) AS o)"),
        "body_line_texts": (body_line_texts, f"SELECT p_brand AS file, {path} AS path, CAST(o AS BIGINT) AS segment, CAST(o * 1600 AS BIGINT) AS top, CAST(1000 AS BIGINT) AS height, CASE o WHEN 0 THEN substring({name16}, 1, 4) ELSE substring({name16}, 5) END AS text {n}, (SELECT unnest([0, 1]) AS o) WHERE p_size % 2 = 0"),
        "segment_styles": (segment_styles, f"SELECT p_brand AS file, {path} AS path, CAST(o AS BIGINT) AS segment, CASE o WHEN 0 THEN p_size ELSE p_partkey END AS char_shape {n}, (SELECT unnest([0, 1]) AS o)"),
        "text_boundaries": (text_boundaries, f"SELECT p_brand AS file, {path} AS path, '0,4' AS places {n}"),
        "large_lines": (large_lines, f"SELECT p_brand AS file, {path} AS path, p_size * 100 / 7200 * 25.4 > 10 AS large {n}"),
        "control_pieces": (control_pieces, f"SELECT p_brand AS file, {path} AS path, CAST(o AS BIGINT) AS ord, CASE o WHEN 2 THEN 'control:26' ELSE 'text' END AS kind, CASE o WHEN 0 THEN 'a' WHEN 1 THEN chr(9) WHEN 2 THEN 'abcd' WHEN 3 THEN '-' ELSE p_brand END AS text {n}, (SELECT unnest(range(5)) AS o)"),
        "body_cells": (body_cells, cell),
        "body_tables": (body_tables, f"SELECT p_brand AS file, {path} || '.c000' AS path, CAST(1 AS BIGINT) AS \"rows\", CAST(2 AS BIGINT) AS cols, CAST(3 AS BIGINT) AS border_fill {n}"),
        "body_zones": (body_zones, f"SELECT p_brand AS file, {path} || '.c000' AS path, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS \"left\", CAST(0 AS BIGINT) AS top, CAST(0 AS BIGINT) AS \"right\", CAST(0 AS BIGINT) AS bottom, CAST(2 * (p_partkey % 2) AS BIGINT) AS fill {n}"),
        "cell_fills": (cell_fills, f"SELECT p_brand AS file, {path} || '.c000.r000.k' || printf('%03d', c) AS path, CAST({fill} AS BIGINT) AS fill_id {n}, (SELECT unnest([0, 1]) AS c)"),
        "table_sizes": (table_sizes, f"SELECT p_brand AS file, {path} || '.c000' AS \"table\", CAST(2 * p_size * 100 AS BIGINT) AS width, p_partkey AS height {n}"),
        "body_markdown": (body_markdown, "SELECT p_brand AS file, string_agg('T' || chr(10) || chr(10) || '| ' || p_name || ' | ' || CAST(p_size AS VARCHAR) || ' |' || chr(10) || '| --- | --- |', chr(10) || chr(10) ORDER BY p_partkey) AS markdown FROM part GROUP BY 1"),
        "compound_json": (compound_json, "SELECT p_partkey, 'compound' AS format, 'T' AS text, p_name AS first, CAST(1 AS BIGINT) AS col, p_partkey AS height, CAST(NULL AS VARCHAR) AS left_out FROM part"),
        "page_geometry": (page_geometry, f"SELECT {first_id}, CAST(CASE WHEN p_size % 2 = 1 THEN 84188 ELSE 59528 END AS BIGINT) AS width, CAST(CASE WHEN p_size % 2 = 1 THEN 59528 ELSE 84188 END AS BIGINT) AS height, CAST(p_size * 100 + 283 AS BIGINT) AS content_left, CAST(5668 + 1000 AS BIGINT) AS content_top, CAST(CASE WHEN p_size % 2 = 1 THEN 84188 ELSE 59528 END - p_size * 100 - 8504 - 283 AS BIGINT) AS content_width, CASE WHEN p_size % 2 = 1 THEN 59528 ELSE 84188 END - 5668 - 4252 - 1000 - p_partkey AS content_height FROM part"),
        "column_definitions": (column_definitions, f"SELECT {first_id}, CASE p_size % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'distributed' ELSE 'parallel' END AS kind, greatest(p_partkey % 5, 1) AS columns, CAST(p_size AS BIGINT) AS gap FROM part"),
        "outline_ids": (outline_ids, f"SELECT {first_id}, nullif(CAST(p_size % 3 AS BIGINT), 0) AS outline FROM part"),
        "note_shapes": (note_shapes, f"SELECT {first_id}, 'footnote' AS kind, CASE p_size % 3 WHEN 0 THEN 'continue' WHEN 1 THEN 'section' ELSE 'page' END AS restart, CAST(p_size AS BIGINT) AS start FROM part"),
        "automatic_numbers": (automatic_numbers, f"WITH e AS (SELECT *, sum(CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) OVER w AS island {n} WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), f AS (SELECT *, coalesce(first_value(CASE WHEN p_size % 7 = 0 THEN p_size END) OVER (PARTITION BY p_brand, island ORDER BY p_partkey), 5) + row_number() OVER (PARTITION BY p_brand, island ORDER BY p_partkey) - 1 AS n FROM e) SELECT p_brand AS file, {path} || '.c001' AS path, CAST(n AS BIGINT) AS n, {sql_by_shape('p_size % 5', 'CAST(n AS BIGINT)')} AS shown FROM f"),
        "marked_paragraphs": (marked_paragraphs, f"SELECT p_brand AS file, {path} AS path, CAST(65536 AS BIGINT) AS mask {n} WHERE p_size % 2 = 0"),
        "held_paragraphs": (held_paragraphs, f"SELECT p_brand AS file, {path} || '.c000.l000.000000' AS path, {path} || '.c000.l000' AS container {n}"),
        "file_headers": (file_headers, f"SELECT o_orderkey, '{{\"version\":\"' || concat_ws('.', ((83886080 + o_orderkey) >> 24) & 255, (o_orderkey >> 16) & 255, (o_orderkey >> 8) & 255, o_orderkey & 255) || '\",\"format\":\"compound\",\"document_flags\":[' || {sql_quoted('(o_orderkey * 16)', dict(enumerate(V.DOCUMENT_FLAGS)))} || '],\"license_flags\":[' || {sql_quoted('(o_orderkey % 8)', dict(enumerate(V.LICENSE_FLAGS)))} || ']}}' AS json FROM orders"),
        "document_metadata": (document_metadata, "SELECT event_id, event_type AS title, strftime(date_trunc('second', ts) + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS created FROM events"),
        "metadata_columns": (metadata_columns, "SELECT event_id, event_type AS title, CAST(NULL AS VARCHAR) AS creator FROM events"),
        "previews": (previews, "SELECT page_id, url AS text, CASE page_id % 3 WHEN 0 THEN 'BMP' WHEN 1 THEN 'GIF' ELSE 'UNKNOWN' END AS format FROM pages"),
        "embedded_files": (embedded_files, "SELECT page_id, printf('BIN%04X', page_id % 60000) AS id, CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'txt' END AS format, md5(html) AS digest FROM pages"),
        "picture_files": (picture_files, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime, CAST(strlen(url) AS BIGINT) AS bytes FROM pages WHERE page_id % 3 < 2"),
        "scripts": (scripts, "SELECT page_id, CAST(1 AS BIGINT) AS high, page_id AS low, url AS head, 'f(' || CAST(page_id AS VARCHAR) || ')' AS source FROM pages"),
        "templates": (templates, "SELECT page_id, url AS schema_name, '<schema/>' AS schema, CAST(NULL AS VARCHAR) AS instance FROM pages"),
        "protected_bodies": (protected_bodies, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS text FROM nation"),
        "key_stream_bytes": (key_stream_bytes, stream),
        "batch_errors": (batch_errors, "SELECT page_id, CASE WHEN page_id % 5 = 0 OR page_id % 3 = 0 THEN 'file' ELSE 'char_shapes' END AS part, CASE WHEN page_id % 5 = 0 THEN 'signature' WHEN page_id % 3 = 0 THEN 'cut_off' ELSE 'encrypted' END AS kind FROM pages WHERE page_id % 5 = 0 OR page_id % 3 = 0 OR page_id % 7 = 0"),
        "table_borders": (table_borders, TABLE_BORDERS.replace("{path}", path).replace("{n}", n).replace("{fill}", fill)),
        "shape_sizes": (shape_sizes, "SELECT p_brand AS file, 'BodyText/Section0' AS stream, count(*) AS shapes, CAST(max(p_size * 100) AS BIGINT) AS tallest, max(p_partkey) AS widest FROM part GROUP BY 1"),
        "field_parameters": (field_parameters, "SELECT page_id, 'n' AS first, page_id AS n, 'Command' AS second, url AS command FROM pages"),
        "sql_functions": (sql_functions, f"SELECT p_partkey, {sql_roman_of('p_partkey')} AS roman, printf('#%02X%02X%02X', p_partkey & 255, (p_partkey >> 8) & 255, (p_partkey >> 16) & 255) AS colour, concat_ws('.', (p_partkey >> 24) & 255, (p_partkey >> 16) & 255, (p_partkey >> 8) & 255, p_partkey & 255) AS version, '&lt;' || p_name || '&gt;' AS name, CASE WHEN p_size IN (0, 10, 13, 24, 30, 31) THEN 'char' WHEN p_size IN (4, 5, 6, 7, 8, 9, 19, 20) THEN 'inline' ELSE 'extended' END AS kind FROM part"),
        "table_svg": (table_svg, TABLE_SVG.replace("{borders}", TABLE_BORDERS.replace("{path}", path).replace("{n}", n).replace("{fill}", fill)).replace("{n}", n).replace("{path}", path)),
    }


def sql_by_shape(shape: str, n: str) -> str:
    from inkstone.plans.scalars import sql_shape

    return sql_shape(f"({shape})", n)


def sql_roman_of(n: str) -> str:
    from inkstone.plans.scalars import sql_roman

    return sql_roman(n)


def sql_quoted(x: str, names: dict[int, str]) -> str:
    """Names of set bits in quotes, comma-joined."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN ({x} >> {b}) & 1 = 1 THEN '\"{name}\"' END" for b, name in names.items()) + ")"


# Borders of the three fills as left, right, top, bottom (line, width); the table's fill is 3, cells have 1, 2 or 3 as {fill} says.
TABLE_BORDERS = """WITH f(id, l, r, t, b) AS (VALUES (1, [1, 5], [1, 5], [1, 5], [1, 5]), (2, [1, 1], [0, 0], [2, 7], [1, 0]), (3, [1, 9], [1, 2], [1, 2], [1, 2])),
c AS (SELECT p_brand AS file, {path} || '.c000' AS tb, c, {fill} AS id {n}, (SELECT unnest([0, 1]) AS c)),
x AS (SELECT c.*, f.* EXCLUDE (id) FROM c JOIN f USING (id)), a AS (SELECT * FROM x WHERE c = 0), z AS (SELECT * FROM x WHERE c = 1), d AS (SELECT * FROM f WHERE id = 3),
e AS (
  SELECT a.file, a.tb, 'v' AS kind, 0 AS "row", 0 AS col, a.l AS own, d.l AS def, true AS outer_ FROM a, d
  UNION ALL SELECT a.file, a.tb, 'v', 0, 1, CASE WHEN a.r[1] = 0 AND z.l[1] = 0 THEN a.r WHEN a.r[1] = 0 THEN z.l WHEN z.l[1] = 0 THEN a.r WHEN z.l[2] > a.r[2] THEN z.l ELSE a.r END, d.l, false FROM a JOIN z ON a.file = z.file AND a.tb = z.tb, d
  UNION ALL SELECT z.file, z.tb, 'v', 0, 2, z.r, d.r, true FROM z, d
  UNION ALL SELECT x.file, x.tb, 'h', 0, c, x.t, d.t, true FROM x, d
  UNION ALL SELECT x.file, x.tb, 'h', 1, c, x.b, d.b, true FROM x, d),
g AS (SELECT *, CASE WHEN own[1] = 0 THEN NULL WHEN outer_ AND def[1] <> 0 AND def[2] <> 0 AND own[2] < def[2] THEN def WHEN NOT outer_ AND own[2] = 0 THEN def ELSE own END AS p FROM e)
SELECT file, tb AS "table", kind, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, CAST(p[1] AS BIGINT) AS line, CAST(p[2] AS BIGINT) AS width, CAST(255 AS BIGINT) AS colour FROM g WHERE p IS NOT NULL AND p[1] <> 0"""


# Equal lines that touch are one path; the first one is the topmost horizontal line of the leftmost cells, 100 units a size wide, in mm.
TABLE_SVG = """WITH b AS ({borders}), r AS (SELECT *, CASE kind WHEN 'v' THEN col ELSE "row" END AS across, CASE kind WHEN 'v' THEN "row" ELSE col END AS along FROM b),
i AS (SELECT *, along - row_number() OVER (PARTITION BY file, "table", kind, across, line, width ORDER BY along) AS run FROM r),
m AS (SELECT file, "table", kind, across, line, width, run, min(along) AS a, max(along) AS z FROM i GROUP BY ALL), c AS (SELECT file, "table", count(*) AS paths FROM m GROUP BY ALL),
f AS (SELECT DISTINCT ON (file, "table") * FROM m ORDER BY file, "table", kind, across, a), p AS (SELECT p_brand AS file, {path} || '.c000' AS "table", p_size * 100 AS w, p_partkey AS h {n}),
g AS (SELECT *, round(w / 7200.0 * 25.4 * 100, 0) / 100 AS w1, round(2 * w / 7200.0 * 25.4 * 100, 0) / 100 AS w2, round(h / 7200.0 * 25.4 * 100, 0) / 100 AS y1 FROM p)
SELECT file, "table", paths, 'M' || printf('%.2f', CASE a WHEN 0 THEN 0.0 ELSE w1 END) || ',' || printf('%.2f', CASE across WHEN 0 THEN 0.0 ELSE y1 END) || 'H' || printf('%.2f', CASE z WHEN 0 THEN w1 ELSE w2 END) AS first FROM c JOIN f USING (file, "table") JOIN g USING (file, "table")"""
