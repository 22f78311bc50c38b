"""Units, colours, bits, versions and times, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_INCH, MM_PER_INCH = 7200, 25.4
#: 100 ns steps from 1601 to 1970.
FILETIME_EPOCH = 116444736000000000
# Line widths in mm by code, names of header flags and control bits.
BORDER_MM = (0.10, 0.12, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 1.00, 1.50, 2.00, 3.00, 4.00, 5.00)
DOCUMENT_FLAGS = ("compressed", "encrypted", "distribution", "script", "drm", "xml_template", "history", "sign", "certificate_encrypt", "sign_spare", "certificate_drm", "ccl", "mobile", "privacy", "track_change", "kogl", "video_control", "table_of_contents")
LICENSE_FLAGS = ("ccl_kogl", "copy_restricted", "copy_allowed_same_condition")
CONTROL_MARKS = {2: "section_column_definition", 3: "field_start", 4: "field_end", 8: "title_mark", 9: "tab", 10: "line_break", 11: "gso_table", 13: "paragraph_break", 15: "hidden_comment", 16: "header_footer", 17: "footnote_endnote", 18: "auto_number", 21: "page_control", 22: "bookmark", 23: "additional_text_overlapping_letter", 24: "hyphen", 30: "bundle_blank", 31: "fix_width_blank"}
DIVIDE_FLAGS = {0: "section", 1: "multi_column", 2: "page", 3: "column"}
LANGUAGES = ("korean", "english", "chinese", "japanese", "other", "symbol", "user")
SEGMENT_FLAGS = {0: "first_in_page", 1: "first_in_column", 16: "empty", 17: "first_in_line", 18: "last_in_line", 19: "auto_hyphenation", 20: "indentation", 21: "paragraph_head"}


def round2(x: Column) -> Column:
    """Two decimals, halves away from zero, by whole hundredths."""
    return F.round(x * 100, 0) / 100


def unit_to_mm(u: Column) -> Column:
    return u / UNITS_PER_INCH * MM_PER_INCH


def mm_to_unit(mm: Column) -> Column:
    return (mm / MM_PER_INCH * UNITS_PER_INCH).cast("long")


def mm_text(x: Column) -> Column:
    r = round2(x)
    return F.when(r == 0, F.lit("0.00mm")).when(r == F.floor(r), F.concat(F.floor(r).cast("long").cast("string"), F.lit("mm"))).otherwise(F.concat(F.format_string("%.2f", r), F.lit("mm")))


def bit(x: Column, b: int) -> Column:
    return F.shiftright(x, b).bitwiseAND(1)


def field(x: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND((1 << width) - 1)


def names_of_bits(x: Column, names: dict[int, str]) -> Column:
    """Names of the set bits, in order, comma-joined."""
    return F.concat_ws(",", *(F.when(bit(x, b) == 1, F.lit(n)) for b, n in names.items()))


def colour_hex(bgr: Column) -> Column:
    """#RRGGBB of a colour stored as blue, green, red from the top."""
    return F.concat(F.lit("#"), *(F.lpad(F.hex(field(bgr, at, 8)), 2, "0") for at in (0, 8, 16)))


def parse_colour(text: Column) -> Column:
    """The number of #RRGGBB; null for anything else."""
    return F.when(text.rlike("^#[0-9A-Fa-f]{6}$"), F.conv(F.substring(text, 2, 6), 16, 10).cast("long"))


def version_text(v: Column) -> Column:
    return F.concat_ws(".", *(field(v, at, 8).cast("string") for at in (24, 16, 8, 0)))


def filetime(ts: Column) -> Column:
    return F.unix_micros(ts) * 10 + FILETIME_EPOCH


def filetime_to_timestamp(ft: Column) -> Column:
    """Whole seconds, cut off."""
    return F.timestamp_seconds(F.floor((ft - FILETIME_EPOCH) / 10_000_000))


def filetime_text(ft: Column) -> Column:
    """Local time of the document format, nine hours ahead (needs a UTC session)."""
    return F.concat(F.date_format(filetime_to_timestamp(ft) + F.expr("interval 9 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def border_mm(code: Column) -> Column:
    return F.when(code.between(0, len(BORDER_MM) - 1), F.element_at(F.array(*map(F.lit, BORDER_MM)), (code + 1).cast("int"))).otherwise(F.lit(0.12))


def border_mm_text(code: Column) -> Column:
    """The width as a style has it; 0.1mm for an unknown code."""
    return F.when(code.between(0, len(BORDER_MM) - 1), F.concat(F.format_string("%s", border_mm(code)), F.lit("mm"))).otherwise(F.lit("0.1mm"))


def bits_of_names(set_: Column, names: dict[int, str]) -> Column:
    """The number whose bits are the names in an array of names."""
    return sum((F.array_contains(set_, n).cast("long") * (1 << b) for b, n in names.items()), F.lit(0).cast("long"))


def seven(values: Column) -> Column:
    """Seven values, one for each group of languages, by name; the last value fills up."""
    return F.struct(*(F.coalesce(F.get(values, F.lit(k)), F.element_at(values, -1)).alias(n) for k, n in enumerate(LANGUAGES)))


def all_seven(values: Column, test) -> Column:
    """Whether a test holds for all seven values."""
    return F.forall(values, test) & (F.size(values) == len(LANGUAGES))


def page_size(width: Column, height: Column, landscape: Column) -> Column:
    """width and height as turned."""
    return F.struct(F.when(landscape, height).otherwise(width).alias("width"), F.when(landscape, width).otherwise(height).alias("height"))


def content_box(size: Column, left: Column, right: Column, top: Column, bottom: Column, header: Column, footer: Column, gutter: Column) -> Column:
    """left, top, width and height of what margins, header, footer and gutter leave of a page."""
    return F.struct((left + gutter).alias("left"), (top + header).alias("top"), (size["width"] - left - right - gutter).alias("width"), (size["height"] - top - bottom - header - footer).alias("height"))


def key_stream(seed: Column, n: int = 256) -> Column:
    """The n bytes of the format's key schedule: values that last for one to sixteen places, by a linear generator."""
    step = lambda s: (s * 214013 + 2531011).bitwiseAND(0x7FFFFFFF)
    start = F.struct(seed.cast("long").alias("state"), F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("left"), F.array().cast("array<bigint>").alias("out"))

    def place(s: Column, _: Column) -> Column:
        fresh = s["left"] == 0
        one = step(s["state"])
        two = step(one)
        value = F.when(fresh, field(one, 16, 8)).otherwise(s["value"])
        left = F.when(fresh, field(two, 16, 4) + 1).otherwise(s["left"])
        return F.struct(F.when(fresh, two).otherwise(s["state"]).alias("state"), value.alias("value"), (left - 1).alias("left"), F.concat(s["out"], F.array(value)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, place, lambda s: s["out"])
