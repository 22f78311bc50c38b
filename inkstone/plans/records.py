"""Records and control headers of the binary format: rows are written as record bytes, packed into compound files, and read back.

The bytes are made here by plain column expressions, field by field, so that writer and reader share no layout. Each query's SQL twin reads the same values from the rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.plans.relations import read, spread
from inkstone.sources import documents
from inkstone.sources.writer import file_header_bytes, to_files

WIDTHS = {"u8": 1, "i8": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "c": 2}


def le(value: Column, n: int) -> Column:
    """n bytes of a number as hexadecimal text, the least first."""
    v = value.cast("long")
    return F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(v, 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)))


def units(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-16LE"))


def counted(text: Column, width: int = 2) -> Column:
    return F.concat(le(F.length(units(text)) / 4, width), units(text))


def one_field(kind: str, expression: str) -> Column:
    if kind.startswith("zero"):
        return F.lit("00" * int(expression))
    if kind == "hex":
        return F.lit(expression)
    value = F.expr(expression)
    if kind == "s":
        return counted(value)
    if kind == "w":
        return units(value)
    if kind == "c":
        return units(F.substring(value, 1, 1))
    return le(value, WIDTHS[kind])


def record(tag: int, level: int, data: Column) -> Column:
    """A record as hexadecimal text; from 4,095 bytes on the size follows the head."""
    size = (F.length(data) / 2).cast("long")
    head = le(F.lit(tag | level << 10) + F.shiftleft(F.least(size, F.lit(0xFFF)), 20), 4)
    return F.concat(head, F.when(size >= 0xFFF, le(size, 4)).otherwise(F.lit("")), data)


def split_spec(spec: str) -> list[tuple[str, str, str]]:
    """(kind, JSON path, expression) of `kind path = expression` lines."""
    return [(m[1], m[2], m[3].strip()) for line in spec.strip().split(";") if (m := re.match(r"\s*(\w+)\s+([\w.\[\]]+)\s*=\s*(.*)", line, re.S))]


def stream_files(rows: DataFrame, file: str, key: str, data: Column, stream: str) -> DataFrame:
    """A compound file for each value of file, whose stream holds the hexadecimal pieces in the order of key."""
    pieces = rows.select(F.col(file).alias("file"), F.struct(F.col(key).alias("k"), data.alias("hex")).alias("x")).groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.unhex(F.array_join(F.transform("xs", lambda x: x["hex"]), ""))
    parts = F.create_map(F.lit("FileHeader"), F.lit(bytearray(file_header_bytes(1))), F.lit(stream), body)
    return to_files(spread(pieces, "file"), F.col("file"), parts, compress=("DocInfo", "BodyText"))


# Rows of part, one record each, in one file for each brand. Expressions are SQL in both engines.
DOC_INFO = {
    0x10: ("document_properties", "u16 area_count = 1; u16 page_start = p_size; u16 footnote_start = p_partkey % 7; u16 endnote_start = 2; u16 picture_start = 3; u16 table_start = 4; u16 equation_start = 5; u32 list_id = p_partkey; u32 para_id = p_partkey * 3; u32 caret = 9"),
    0x11: ("id_mappings", "; ".join(f"i32 counts[{k}] = p_partkey + {k}" for k in range(18))),
    0x12: ("bin_data", "u16 attribute = 1; u16 bin_item = p_partkey % 65000; s extension = p_type"),
    0x13: ("face_name", "u8 attribute = 224; s name = p_name; u8 substitute_kind = p_size % 3; s substitute = p_type; u8 facts[0] = p_size; zero _ = 9; s standard = p_brand"),
    0x14: ("border_fill", "u16 attribute = p_size; " + "; ".join(f"u8 borders[{k}].line = p_size % 16; u8 borders[{k}].width = (p_size + {k}) % 16; u32 borders[{k}].colour = p_partkey * 7" for k in range(4)) + "; u8 diagonal = 1; u8 diagonal_width = 2; u32 diagonal_colour = 255; u32 fill_kind = 1; u32 background = p_partkey; u32 pattern_colour = 8; i32 pattern = 0 - p_size"),
    0x15: ("char_shape", "; ".join(f"u16 fonts[{k}] = p_size + {k}" for k in range(7)) + "; " + "; ".join(f"u8 ratios[{k}] = 100 - {k}" for k in range(7)) + "; " + "; ".join(f"i8 spacings[{k}] = {k} - p_size" for k in range(7)) + "; " + "; ".join(f"u8 sizes[{k}] = 90 + {k}" for k in range(7)) + "; zero _ = 7; i32 height = p_partkey; u32 attribute = p_size * 1000; i8 shadow_x = 3; i8 shadow_y = 0 - 3; u32 colour = p_partkey * 11; u32 underline_colour = 1; u32 shade_colour = 2; u32 shadow_colour = 3; u16 border_fill = p_size; u32 strike_colour = 4"),
    0x16: ("tab_def", "u32 attribute = p_size; i16 n = 2; u32 tabs[0].position = p_partkey * 10; u8 tabs[0].kind = p_size % 4; u8 tabs[0].fill = 1; zero _ = 2; u32 tabs[1].position = p_partkey * 20; u8 tabs[1].kind = 3; u8 tabs[1].fill = 0; zero _ = 2"),
    0x17: ("numbering", "; ".join(f"u32 levels[{k}].attribute = p_size * 32; i16 levels[{k}].width = 0 - {k}; i16 levels[{k}].distance = 50; u32 levels[{k}].char_shape = p_partkey; s levels[{k}].format = '^{k + 1}.'" for k in range(7)) + "; " + "; ".join(f"u16 starts[{k}] = p_size" for k in range(7)) + "; " + "; ".join(f"u32 level_starts[{k}] = p_partkey + {k}" for k in range(7)) + "; " + "; ".join(f"s further[{k}].format = p_brand" for k in range(3))),
    0x18: ("bullet", "u32 attribute = p_size; i16 width = 0 - 5; i16 distance = 50; i32 char_shape = 0 - 1; u16 mark = 61548 + p_size % 3; i32 image = 0; u8 contrast = 1; u8 brightness = 2; u8 effect = 3; u8 image_id = 4; u16 check_mark = 9745"),
    0x19: ("para_shape", "u32 attribute1 = p_size * 65536; i32 left = 0 - p_partkey; i32 right = p_partkey; i32 indent = 0 - 20; i32 before = 1; i32 after = 2; i32 spacing_old = 160; u16 tab_def = 1; u16 numbering = p_size; u16 border_fill = 3; i16 border_spacing[0] = 0 - 1; i16 border_spacing[1] = 1; i16 border_spacing[2] = 2; i16 border_spacing[3] = 3; u32 attribute2 = 7; u32 attribute3 = 8; i32 spacing = 130 + p_size"),
    0x1A: ("style", "s name = p_name; s english = p_type; u8 attribute = 1; u8 next = p_size; i16 language = 1042; u16 para_shape = p_partkey % 60000; u16 char_shape = p_size"),
    0x1B: ("doc_data", "u16 items.set_id = 535; i16 _ = 3; u16 items.items[0].id = 1; u16 items.items[0].kind = 4; i32 items.items[0].value = 0 - p_partkey; u16 items.items[1].id = 2; u16 items.items[1].kind = 1; s items.items[1].value = p_brand; u16 items.items[2].id = 3; u16 items.items[2].kind = 32768; u16 items.items[2].value.set_id = 9; i16 _ = 1; u16 items.items[2].value.items[0].id = 5; u16 items.items[2].value.items[0].kind = 7; u16 items.items[2].value.items[0].value = p_size"),
    0x1C: ("distribute_doc_data", "u32 _ = p_partkey; zero _ = 252"), 0x1E: ("compatible_document", "u32 program = p_size % 3"),
    0x1F: ("layout_compatibility", "u32 letter = p_size; u32 paragraph = p_partkey; u32 section = 1; u32 object = 2; u32 field = 3"),
    0x20: ("track_change", "u32 _ = p_partkey"), 0x5C: ("memo_shape", "u32 _ = p_partkey"), 0x5E: ("forbidden_char", "u32 _ = p_partkey"), 0x60: ("track_change_content", "u32 _ = p_partkey"), 0x61: ("track_change_author", "w _ = p_brand"),
}
OBJECT = "u32 attribute = p_size; i32 y = 0 - p_partkey; i32 x = p_partkey; u32 width = 14173; u32 height = p_size * 100; i32 order = p_size - 25; i16 margins[0] = 283; i16 margins[1] = 283; i16 margins[2] = 0 - 1; i16 margins[3] = 2; u32 instance = p_partkey * 5; i32 no_page_split = 1; s description = p_name"
XY = "; ".join(f"i32 x[{k}] = p_partkey - {k}" for k in range(4)) + "; " + "; ".join(f"i32 y[{k}] = p_size - 30 - {k}" for k in range(4))
BODY = {
    0x42: ("para_header", "u32 units = p_size; u32 control_mask = p_partkey * 4; u16 para_shape = p_size; u8 style = 3; u8 split = p_size % 16; u16 char_shapes = 1; u16 range_tags = 0; u16 line_segments = 2; u32 instance = p_partkey; u16 merged = 1"),
    0x43: ("para_text", "w _ = p_name"), 0x44: ("para_char_shape", "u32 changes[0].position = 0; u32 changes[0].shape = p_size; u32 changes[1].position = 4; u32 changes[1].shape = p_partkey"),
    0x45: ("para_line_seg", "; ".join(f"u32 segments[{k}].start = {k} * p_size; i32 segments[{k}].top = p_partkey * {k}; i32 segments[{k}].height = 1000; i32 segments[{k}].text_height = 900; i32 segments[{k}].baseline = 850; i32 segments[{k}].gap = 600; i32 segments[{k}].left = 0 - 5; i32 segments[{k}].width = 42520; u32 segments[{k}].flags = 393216" for k in range(2))),
    0x46: ("para_range_tag", "u32 ranges[0].start = 1; u32 ranges[0].end = 1 + p_size; u32 ranges[0].tag = p_partkey"), 0x48: ("list_header", "i16 paragraphs = p_size; zero _ = 2; u32 attribute = p_partkey * 32"),
    0x49: ("page_def", "u32 width = 59528; u32 height = 84188 + p_size; u32 left = 8504; u32 right = 8504; u32 top = 5668; u32 bottom = 4252; u32 header = 4252; u32 footer = 4252; u32 gutter = p_partkey; u32 attribute = p_size % 2"),
    0x4A: ("footnote_shape", "u32 attribute = p_size; u16 user_mark = 42; u16 before_mark = 40; u16 after_mark = 41; u16 start = p_size; i16 line_length = 0 - 1; i16 above = 850; i16 below = 567; i16 between = 283; u8 line = 1; u8 width = 2; u32 colour = p_partkey"),
    0x4B: ("page_border_fill", "u32 attribute = p_size % 8; i16 left = 1417; i16 right = 1417; i16 top = 0 - 5; i16 bottom = 1417; u16 border_fill = p_size"),
    0x4C: ("shape_component", "hex _ = 63657224; hex _ = 63657224; i32 x = 0 - p_size; i32 y = p_size; u16 level = 1; u16 version = 1; u32 first_width = p_partkey; u32 first_height = 2; u32 width = p_partkey * 2; u32 height = 4; u32 attribute = p_size % 2; i16 angle = 0 - 90; i32 centre_x = 1; i32 centre_y = 2; u16 matrices = 1; zero _ = 144; u32 line_colour = p_partkey; i32 line_width = 33; u32 line_attribute = 65; u8 outline = 1; u32 fill_kind = 1; u32 background = p_partkey * 3; u32 pattern_colour = 5; i32 pattern = 0 - 1"),
    0x4D: ("table", "u32 attribute = 4; u16 rows = 2; u16 cols = 3; i16 spacing = 0; i16 left = 510; i16 right = 510; i16 top = 141; i16 bottom = 0 - 141; u16 row_sizes[0] = 3; u16 row_sizes[1] = p_size; u16 border_fill = p_size; u16 zones = 1; u16 zone_list[0].left = 0; u16 zone_list[0].top = 1; u16 zone_list[0].right = 2; u16 zone_list[0].bottom = 1; u16 zone_list[0].border_fill = p_partkey % 60000"),
    0x4E: ("line", "i32 start_x = 0 - p_partkey; i32 start_y = 1; i32 end_x = p_partkey; i32 end_y = p_size; u16 attribute = 1"), 0x4F: ("rectangle", "u8 round = p_size; " + XY),
    0x50: ("ellipse", "u32 attribute = p_size; " + "; ".join(f"i32 {n} = p_partkey - {k}" for k, n in enumerate("centre_x centre_y axis1_x axis1_y axis2_x axis2_y start_x start_y end_x end_y start_x2 interval start_y2 end_x2 end_y2".split()))),
    0x51: ("arc", "u32 attribute = 1; " + "; ".join(f"i32 {n} = {k} - p_partkey" for k, n in enumerate("centre_x centre_y axis1_x axis1_y axis2_x axis2_y".split()))),
    0x52: ("polygon", "i16 n = 3; " + "; ".join(f"i32 x[{k}] = p_partkey + {k}" for k in range(3)) + "; " + "; ".join(f"i32 y[{k}] = {k} - p_size" for k in range(3))),
    0x53: ("curve", "i16 n = 3; " + "; ".join(f"i32 x[{k}] = p_partkey + {k}" for k in range(3)) + "; " + "; ".join(f"i32 y[{k}] = {k} - p_size" for k in range(3)) + "; u8 parts[0] = 1; u8 parts[1] = p_size % 2"),
    0x54: ("ole", "u16 attribute = p_size; i32 width = p_partkey; i32 height = 0 - 3; u16 bin_item = p_size; u32 border_colour = 7; i32 border_width = 33; u32 border = p_partkey"),
    0x55: ("picture", "u32 border_colour = p_partkey; i32 border_width = 0 - 2; u32 border = 3; " + XY + "; i32 crop_left = 1; i32 crop_top = 2; i32 crop_right = p_partkey; i32 crop_bottom = 4; i16 left = 5; i16 right = 0 - 6; i16 top = 7; i16 bottom = 8; i8 brightness = 0 - p_size; i8 contrast = p_size; u8 effect = 2; u16 bin_item = p_partkey % 60000; u8 transparency = 9; u32 instance = p_partkey * 13"),
    0x56: ("container", "u16 n = 2; u32 children[0] = 611349860; u32 children[1] = p_partkey"), 0x57: ("ctrl_data", "u16 items.set_id = 27; i16 _ = 1; u16 items.items[0].id = p_size; u16 items.items[0].kind = 8; u32 items.items[0].value = p_partkey"),
    0x58: ("equation", "u32 attribute = 0; s script = p_name; u32 size = 1000; u32 colour = p_partkey; i16 baseline = 0 - p_size; s version = p_brand; s font = p_type"),
    0x5A: ("text_art", "u32 _ = p_partkey"), 0x5B: ("form_object", "u32 _ = p_partkey"), 0x5D: ("memo_list", "u32 _ = p_partkey"), 0x5F: ("chart_data", "u32 _ = p_partkey"), 0x62: ("video", "i32 kind = 1; w web_tag = p_name; u16 thumbnail = p_size"), 0x73: ("unknown_object", "u32 _ = p_partkey"),
}
NUMBER = "u32 attribute = p_size * 16 + 4; u16 number = p_partkey % 60000; c user_mark = '*'; c before_mark = '('; c after_mark = ')'"
AROUND = "u32 attribute = p_size % 3; u32 width = p_partkey; u32 height = 4252; u8 text_ref = 1; u8 number_ref = p_size"
NOTE = "u8 number = p_size; zero _ = 5; u8 attribute = 1; zero _ = 1"
CONTROLS = {
    "tbl ": OBJECT, "gso ": OBJECT, "secd": "u32 attribute = p_size; i16 column_gap = 1134; i16 vertical_grid = 0; i16 horizontal_grid = 0 - 1; u32 tab = 8000; u16 numbering = 1; u16 page_start = p_size; u16 picture_start = 2; u16 table_start = 3; u16 equation_start = 4; u16 language = 1042",
    "cold": "u16 attribute = 8; i16 gap = p_size; i16 widths[0] = p_partkey % 30000; i16 widths[1] = 7; u16 attribute2 = 1; u8 line = 2; u8 line_width = 3; u32 line_colour = p_partkey", "head": AROUND, "foot": AROUND, "fn  ": NOTE, "en  ": NOTE, "atno": NUMBER, "autn": NUMBER,
    "newn": "u32 attribute = p_size % 6; u16 number = p_partkey % 60000", "nwno": "u32 attribute = p_size % 6; u16 number = p_partkey % 60000", "pgnp": NUMBER, "pghd": "u16 attribute = p_size", "pgad": "u32 attribute = p_partkey", "bkmk": "s name = p_name; s name2 = p_brand", "bokm": "s name = p_name; s name2 = p_type",
    "over": "hex _ = 7265766F; s text = p_brand; u8 border = 1; i8 size = 0 - p_size; u8 spread = 2; u8 n = 2; u32 char_shapes[0] = 3; u32 char_shapes[1] = p_partkey", "cmtt": "s main = p_name; s sub = p_brand; u32 position = 1; u32 size = p_size; u32 option = 3; u32 style = 4; u32 align = p_partkey",
    "hide": "", "%hlk": "u32 attribute = 1; u8 more = p_size; s command = p_name; u32 id = p_partkey", "%bmk": "u32 attribute = p_partkey; u8 more = 1; s command = p_brand; u32 id = p_size",
}


def record_query(tag: int, name: str, spec: str, stream: str, control: str = ""):
    """file (the brand), seq, and the fields of a record that each row of part was written as; the SQL twin."""
    fields = split_spec(spec)
    shown = [(kind, path, expression) for kind, path, expression in fields if path != "_"]
    alias = lambda path: re.sub(r"\W+", "_", path).strip("_")

    def run(spark: SparkSession, d: str) -> DataFrame:
        data = [F.lit(control[::-1].encode().hex())] if control else []
        data += [one_field(kind, expression) for kind, _, expression in fields]
        files = stream_files(read(spark, d, "part"), "p_brand", "p_partkey", record(tag, 1, F.concat(*data) if data else F.lit("")), stream)
        found = documents.read_table(files, "records").where(F.col("name") == name)
        cols = [F.get_json_object("fields", f"$.{path}").cast("string" if kind in "swc" else "long").alias(alias(path)) for kind, path, _ in shown]
        if not shown:
            cols = [F.get_json_object("fields", "$.data" if name != "para_text" else "$.units").alias("data")] if fields else [F.get_json_object("fields", "$.control").alias("control")]
        return found.select("file", "seq", *cols)

    def sql_value(kind: str, expression: str) -> str:
        return f"CAST({expression} AS {'VARCHAR' if kind in 'swc' else 'BIGINT'})"

    if shown:
        cols = ", ".join(f"{sql_value(kind, expression)} AS {alias(path)}" for kind, path, expression in shown)
    elif fields and fields[0][0] == "w":
        # UTF-16 of ASCII names: each byte and a zero.
        cols = f"lower(regexp_replace(hex(encode({fields[0][2]})), '(..)', '\\100', 'g')) AS data"
    elif fields:
        cols = "printf('%02x%02x%02x%02x', p_partkey & 255, (p_partkey >> 8) & 255, (p_partkey >> 16) & 255, (p_partkey >> 24) & 255) || repeat('00', {}) AS data".format(sum(int(e) for k, _, e in fields if k == "zero"))
    else:
        cols = f"'{control}' AS control"
    return run, f"SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS seq, {cols} FROM part"


def catalog() -> dict:
    from inkstone.sources import layouts

    out = {}
    for table, stream in ((DOC_INFO, "DocInfo"), (BODY, "BodyText/Section0")):
        for tag, (name, spec) in table.items():
            out[f"record_{name}"] = record_query(tag, name, spec, stream)
    for control, spec in CONTROLS.items():
        name = "field" if control[0] == "%" else layouts.CONTROLS[control][0]
        out[f"control_{control.strip(' %')}_{name}"] = record_query(0x47, name, spec, "BodyText/Section0", control)
    return out
