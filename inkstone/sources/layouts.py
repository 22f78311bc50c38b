"""Field layouts of all record kinds and control headers, as data, and one reader for them.

A layout is a text of fields `type name`, comma-separated; `type*n` repeats a fixed number of times, `type[count]` as often as the field `count` says (or a count
that COUNTS derives), `type[*]` to the end, `type?field&bits` only where the field has one of the bits, `{...}[count]` repeats a group. Types: u8 i8 u16 i16 u32 i32 f64,
`c` (one two-byte unit), `s` (two-byte units with their count in front), `t` (the same, at least one unit long), `w` (two-byte units up to the last two bytes),
`id` (four letters, stored backwards), `di` (four letters as stored), `set` (a parameter set), `rest` (hexadecimal). Newer files have more fields and older ones fewer: reading stops where the data end, and fields
beyond are absent. Where the data decide between layouts, `layout_of` does.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

FILL = "u32 fill_kind, u32?fill_kind&1 background, u32?fill_kind&1 pattern_colour, i32?fill_kind&1 pattern, u8?fill_kind&4 gradient, i32?fill_kind&4 gradient_angle, i32?fill_kind&4 gradient_x, i32?fill_kind&4 gradient_y, i32?fill_kind&4 gradient_spread, i32?fill_kind&4 n_colours, i32[gradient_places] places, u32[gradient_colours] colours, rest more"
BORDERS = "{u8 line, u8 width, u32 colour}*4 borders"
BORDERS_APART = "u8*4 lines, u8*4 widths, u32*4 line_colours"
BORDER_FILL = "u16 attribute, %s, u8 diagonal, u8 diagonal_width, u32 diagonal_colour, " + FILL
# Record layouts by tag.
RECORDS: dict[int, tuple[str, str]] = {
    0x10: ("document_properties", "u16 area_count, u16 page_start, u16 footnote_start, u16 endnote_start, u16 picture_start, u16 table_start, u16 equation_start, u32 list_id, u32 para_id, u32 caret"),
    0x11: ("id_mappings", "i32*18 counts"),
    0x12: ("bin_data", "u16 attribute, u16 bin_item, s extension"),
    0x13: ("face_name", "u8 attribute, s name, u8?attribute&128 substitute_kind, s?attribute&128 substitute, u8[face_facts] facts, s?attribute&32 standard"),
    0x14: ("border_fill", BORDER_FILL % BORDERS),
    0x15: ("char_shape", "u16*7 fonts, u8*7 ratios, i8*7 spacings, u8*7 sizes, i8*7 offsets, i32 height, u32 attribute, i8 shadow_x, i8 shadow_y, u32 colour, u32 underline_colour, u32 shade_colour, u32 shadow_colour, u16 border_fill, u32 strike_colour"),
    0x16: ("tab_def", "u32 attribute, i16 n, {u32 position, u8 kind, u8 fill, u16 reserved}[n] tabs"),
    0x17: ("numbering", "{u32 attribute, i16 width, i16 distance, u32 char_shape, s format}*7 levels, u16*7 starts, u32*7 level_starts, {s format}*3 further"),
    0x18: ("bullet", "u32 attribute, i16 width, i16 distance, i32 char_shape, u16 mark, i32 image, u8 contrast, u8 brightness, u8 effect, u8 image_id, u16 check_mark"),
    0x19: ("para_shape", "u32 attribute1, i32 left, i32 right, i32 indent, i32 before, i32 after, i32 spacing_old, u16 tab_def, u16 numbering, u16 border_fill, i16*4 border_spacing, u32 attribute2, u32 attribute3, i32 spacing"),
    0x1A: ("style", "s name, s english, u8 attribute, u8 next, i16 language, u16 para_shape, u16 char_shape"),
    0x1B: ("doc_data", "set items"),
    0x1C: ("distribute_doc_data", "rest data"),
    0x1E: ("compatible_document", "u32 program"),
    0x1F: ("layout_compatibility", "u32 letter, u32 paragraph, u32 section, u32 object, u32 field"),
    0x20: ("track_change", "rest data"),
    0x5C: ("memo_shape", "rest data"),
    0x5E: ("forbidden_char", "rest data"),
    0x60: ("track_change_content", "rest data"),
    0x61: ("track_change_author", "rest data"),
    0x42: ("para_header", "u32 units, u32 control_mask, u16 para_shape, u8 style, u8 split, u16 char_shapes, u16 range_tags, u16 line_segments, u32 instance, u16 merged"),
    0x43: ("para_text", "rest units"),
    0x44: ("para_char_shape", "{u32 position, u32 shape}[*] changes"),
    0x45: ("para_line_seg", "{u32 start, i32 top, i32 height, i32 text_height, i32 baseline, i32 gap, i32 left, i32 width, u32 flags}[*] segments"),
    0x46: ("para_range_tag", "{u32 start, u32 end, u32 tag}[*] ranges"),
    0x47: ("ctrl_header", "u32 control, rest data"),
    0x48: ("list_header", "i16 paragraphs, u16 reserved, u32 attribute, rest data"),
    0x49: ("page_def", "u32 width, u32 height, u32 left, u32 right, u32 top, u32 bottom, u32 header, u32 footer, u32 gutter, u32 attribute"),
    0x4A: ("footnote_shape", "u32 attribute, u16 user_mark, u16 before_mark, u16 after_mark, u16 start, i16 line_length, i16 above, i16 below, i16 between, u8 line, u8 width, u32 colour"),
    0x4B: ("page_border_fill", "u32 attribute, i16 left, i16 right, i16 top, i16 bottom, u16 border_fill"),
    0x4C: ("shape_component", "di kind, di kind_again, i32 x, i32 y, u16 level, u16 version, u32 first_width, u32 first_height, u32 width, u32 height, u32 attribute, i16 angle, i32 centre_x, i32 centre_y, u16 matrices, f64*6 translation, {f64*6 scale, f64*6 rotation}[matrices] steps, u32 line_colour, i32 line_width, u32 line_attribute, u8 outline, " + FILL),
    0x4D: ("table", "u32 attribute, u16 rows, u16 cols, i16 spacing, i16 left, i16 right, i16 top, i16 bottom, u16[rows] row_sizes, u16 border_fill, u16 zones, {u16 left, u16 top, u16 right, u16 bottom, u16 border_fill}[zones] zone_list"),
    0x4E: ("line", "i32 start_x, i32 start_y, i32 end_x, i32 end_y, u16 attribute"),
    0x4F: ("rectangle", "u8 round, i32*4 x, i32*4 y"),
    0x50: ("ellipse", "u32 attribute, i32 centre_x, i32 centre_y, i32 axis1_x, i32 axis1_y, i32 axis2_x, i32 axis2_y, i32 start_x, i32 start_y, i32 end_x, i32 end_y, i32 start_x2, i32 interval, i32 start_y2, i32 end_x2, i32 end_y2"),
    0x51: ("arc", "u32 attribute, i32 centre_x, i32 centre_y, i32 axis1_x, i32 axis1_y, i32 axis2_x, i32 axis2_y"),
    0x52: ("polygon", "i16 n, i32[n] x, i32[n] y"),
    0x53: ("curve", "i16 n, i32[n] x, i32[n] y, u8[curve_parts] parts"),
    0x54: ("ole", "u16 attribute, i32 width, i32 height, u16 bin_item, u32 border_colour, i32 border_width, u32 border"),
    0x55: ("picture", "u32 border_colour, i32 border_width, u32 border, i32*4 x, i32*4 y, i32 crop_left, i32 crop_top, i32 crop_right, i32 crop_bottom, i16 left, i16 right, i16 top, i16 bottom, i8 brightness, i8 contrast, u8 effect, u16 bin_item, u8 transparency, u32 instance, rest effects"),
    0x56: ("container", "u16 n, u32[n] children"),
    0x57: ("ctrl_data", "set items"),
    0x58: ("equation", "u32 attribute, s script, u32 size, u32 colour, i16 baseline, s version, s font"),
    0x5A: ("text_art", "rest data"),
    0x5B: ("form_object", "rest data"),
    0x5D: ("memo_list", "rest data"),
    0x5F: ("chart_data", "rest data"),
    0x62: ("video", "i32 kind, u16 bin_item, u16 thumbnail"),
    0x73: ("unknown_object", "rest data"),
}
OBJECT = "u32 attribute, i32 y, i32 x, u32 width, u32 height, i32 order, i16*4 margins, u32 instance, i32 no_page_split, s description"
FIELD = "u32 attribute, u8 more, s command, u32 id"
AUTO_NUMBER, NEW_NUMBER = ("auto_number", "u32 attribute, u16 number, c user_mark, c before_mark, c after_mark"), ("new_number", "u32 attribute, u16 number")
PAGE_NUMBER = ("page_number_position", "u32 attribute, u16 number, c user_mark, c before_mark, c after_mark")
OVERLAP, RUBY = ("overlap", "id control_again, s text, u8 border, i8 size, u8 spread, u8 n, u32[n] char_shapes"), ("ruby", "t main, t sub, u32 position, u32 size, u32 option, u32 style, u32 align")
NOTE = "u8 number, u8*5 reserved, u8 attribute, u8 reserved2"
AROUND = "u32 attribute, u32 width, u32 height, u8 text_ref, u8 number_ref"
# Control headers by their four letters, all spellings in use.
CONTROLS: dict[str, tuple[str, str]] = {
    "tbl ": ("table", OBJECT), "gso ": ("shape", OBJECT), "eqed": ("equation", OBJECT), "form": ("form", OBJECT),
    "secd": ("section", "u32 attribute, i16 column_gap, i16 vertical_grid, i16 horizontal_grid, u32 tab, u16 numbering, u16 page_start, u16 picture_start, u16 table_start, u16 equation_start, u16 language"),
    "cold": ("columns", "u16 attribute, i16 gap, i16[column_widths] widths, u16 attribute2, u8 line, u8 line_width, u32 line_colour"), "head": ("header", AROUND), "foot": ("footer", AROUND),
    "fn  ": ("footnote", NOTE), "en  ": ("endnote", NOTE), "atno": AUTO_NUMBER, "autn": AUTO_NUMBER, "nwno": NEW_NUMBER, "newn": NEW_NUMBER, "pgnp": PAGE_NUMBER, "pgno": PAGE_NUMBER,
    "pghd": ("page_hiding", "u16 attribute"), "pgad": ("page_adjust", "u32 attribute"), "pgct": ("page_adjust", "u32 attribute"), "bkmk": ("bookmark", "s name, s name2"), "bokm": ("bookmark", "s name, s name2"),
    "over": OVERLAP, "tcps": OVERLAP, "cmtt": RUBY, "tdut": RUBY, "hide": ("hidden_comment", ""), "tcmt": ("hidden_comment", ""),
}
#: Counts that follow from other fields.
COUNTS = {
    "column_widths": lambda k: 0 if k["attribute"] & 0x1000 else max(1, k["attribute"] >> 2 & 0xFF),
    "curve_parts": lambda k: k["n"] - 1,
    "face_facts": lambda k: 10 if k["attribute"] & 0x40 else 0,
    "gradient_colours": lambda k: k["n_colours"] if k.get("fill_kind", 0) & 4 else 0,
    "gradient_places": lambda k: k["n_colours"] if k.get("fill_kind", 0) & 4 and k["n_colours"] > 2 else 0,
}
#: Parameter kinds: the type of the value.
PARAMETERS = {0: "", 1: "s", 2: "i8", 3: "i16", 4: "i32", 5: "i8", 6: "u8", 7: "u16", 8: "u32", 9: "u8", 0x8000: "set", 0x8002: "u16"}
SIMPLE = {"u8": "B", "i8": "b", "u16": "H", "i16": "h", "u32": "I", "i32": "i", "f64": "d"}


class Ended(Exception):
    """The data end inside a field."""


@lru_cache(maxsize=None)
def split_fields(spec: str) -> list[tuple[str, str, str]]:
    """(type or group, repeat, name) of each field."""
    return [(m[1] or m[2], m[3] or "", m[4]) for m in re.finditer(r"(?:\{([^}]*)\}|([a-z]+[0-9]*))(\*[0-9]+|\[[a-z_*]+\]|\?[a-z_]+&[0-9]+)? ([a-z0-9_]+)", spec)]


def read_units(raw: bytes, at: int, n: int, least: int = 0) -> tuple[str, int]:
    if at + 2 * n > len(raw):
        raise Ended
    return raw[at : at + 2 * n].decode("utf-16-le", "replace"), at + 2 * max(n, least)


def read_one(kind: str, raw: bytes, at: int):
    if kind in SIMPLE:
        f = "<" + SIMPLE[kind]
        if at + struct.calcsize(f) > len(raw):
            raise Ended
        return struct.unpack_from(f, raw, at)[0], at + struct.calcsize(f)
    if kind in ("s", "t"):
        n, at = read_one("u16", raw, at)
        return read_units(raw, at, n, int(kind == "t"))
    if kind == "c":
        return read_units(raw, at, 1)
    if kind == "w":
        return read_units(raw, at, max(0, len(raw) - 2 - at) // 2)
    if kind in ("id", "di"):
        if at + 4 > len(raw):
            raise Ended
        return raw[at : at + 4][:: -1 if kind == "id" else 1].decode("latin-1").rstrip("\0").rstrip(" "), at + 4
    if kind == "rest":
        return raw[at:].hex(), len(raw)
    if kind == "set":
        return read_set(raw, at)
    out: dict = {}
    for inner, repeat, name in split_fields(kind):
        out[name], at = read_field(inner, repeat, raw, at, out)
    return out, at


def read_set(raw: bytes, at: int) -> tuple[dict, int]:
    """A parameter set: its id and items (id, kind, value); sets nest, and an item of unknown kind has no value."""
    set_id, at = read_one("u16", raw, at)
    n, at = read_one("i16", raw, at)
    out: dict = {"set_id": set_id, "items": []}
    for _ in range(max(0, n)):
        try:
            key, at = read_one("u16", raw, at)
            kind, at = read_one("u16", raw, at)
            value = None
            if kind == 0x8001:
                count, at = read_one("i16", raw, at)
                value = []
                for _ in range(max(0, count)):
                    one, at = read_set(raw, at)
                    value.append(one)
            elif PARAMETERS.get(kind):
                value, at = read_one(PARAMETERS[kind], raw, at)
        except Ended:
            break
        out["items"].append({"id": key, "kind": kind, "value": value})
    return out, at


def read_field(kind: str, repeat: str, raw: bytes, at: int, known: dict):
    if not repeat:
        return read_one(kind, raw, at)
    if repeat[0] == "?":
        field, bits = repeat[1:].split("&")
        return read_one(kind, raw, at) if known.get(field, 0) & int(bits) else (None, at)
    if repeat[0] == "*":
        n = int(repeat[1:])
    elif repeat == "[*]":
        n = None
    else:
        n = max(0, int(COUNTS[repeat[1:-1]](known) if repeat[1:-1] in COUNTS else known.get(repeat[1:-1], 0)))
    out = []
    while (at < len(raw)) if n is None else len(out) < n:
        value, at = read_one(kind, raw, at)
        out.append(value)
    return out, at


def borders_score(borders: list[dict]) -> int:
    """How likely four borders are what their bytes were meant for: known widths and lines, a colour that is one."""
    return sum((3 if b["width"] <= 15 else -10) + (2 if b["line"] <= 32 else -5) - 2 * (b["colour"] == 0xFFFFFFFF) for b in borders)


def layout_of(tag: int, raw: bytes) -> tuple[str, str]:
    """The name and layout of a record, which its data may decide."""
    name, spec = RECORDS.get(tag, ("unknown", "rest data"))
    if name == "list_header" and len(raw) < 8:
        spec = "i16 paragraphs, u32 attribute"
    elif name == "bin_data" and raw and not raw[0] & 0xF:
        spec = "u16 attribute, s path, s relative_path"
    elif name == "bin_data" and raw and raw[0] & 0xF == 2:
        spec = "u16 attribute, u16 bin_item"
    elif name == "video" and raw[:4] == b"\1\0\0\0":
        spec = "i32 kind, w web_tag, u16 thumbnail"
    elif name == "border_fill" and len(raw) >= 26:
        together, apart = read_fields("u16 attribute, " + BORDERS, raw)["borders"], paired(read_fields("u16 attribute, " + BORDERS_APART, raw))
        if borders_score(apart) > borders_score(together):
            spec = BORDER_FILL % BORDERS_APART
    return name, spec


def paired(fields: dict) -> list[dict]:
    return [{"line": a, "width": b, "colour": c} for a, b, c in zip(fields["lines"], fields["widths"], fields["line_colours"], strict=True)]


def read_fields(spec: str, raw: bytes) -> dict:
    """Fields by name, as far as the data go."""
    out: dict = {}
    at = 0
    for kind, repeat, name in split_fields(spec):
        try:
            out[name], at = read_field(kind, repeat, raw, at, out)
        except Ended:
            break
    return out


def describe(tag: int, raw: bytes) -> tuple[str, dict]:
    """The name and fields of a record; control headers have the control's name and fields."""
    if tag == 0x47 and len(raw) >= 4:
        control = raw[:4][::-1].decode("latin-1")
        name, spec = ("field", FIELD) if control.startswith("%") else CONTROLS.get(control, ("control", "rest data"))
        return name, {"control": control} | read_fields(spec, raw[4:])
    name, spec = layout_of(tag, raw)
    fields = {k: v for k, v in read_fields(spec, raw).items() if v is not None}
    if "lines" in fields and "line_colours" in fields:
        fields["borders"] = paired(fields)
        for k in ("lines", "widths", "line_colours"):
            del fields[k]
    return name, fields


def caption(raw: bytes) -> dict | None:
    """Fields of a list header that holds a caption; None where it is too short for one."""
    if len(raw) < 22:
        return None
    f = read_fields("i16 paragraphs, u16 reserved, u32 attribute, u32 caption, u32 width, i16 gap, u32 last_width", raw)
    return {
        "align": ("left", "right", "top", "bottom")[f["caption"] & 3], "with_margin": bool(f["caption"] & 4), "width": f["width"], "gap": f["gap"], "last_width": f["last_width"],
        "vertical": ("top", "middle", "bottom", "middle")[f["attribute"] >> 5 & 3],
    }
