"""Text, markup and link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters that are one unit long, those with letters of their own in place, and their names from 0 to 31 (those without are reserved).
CONTROL_SINGLE = frozenset((0, 10, 13, 24, 30, 31))
CONTROL_INLINE = frozenset((4, 5, 6, 7, 8, 9, 19, 20))
CONTROL_NAMES = {0: "NULL", 4: "FIELD_END", 8: "TITLE_MARK", 9: "TAB", 10: "LINE_BREAK", 11: "SHAPE_OBJECT", 13: "PARA_BREAK", 15: "HIDDEN_DESC", 16: "HEADER_FOOTER", 17: "FOOTNOTE", 18: "AUTO_NUMBER", 21: "PAGE_CONTROL", 22: "BOOKMARK", 23: "COMMENT_OVERLAP", 24: "HYPHEN", 30: "BOUND_SPACE", 31: "FIXED_SPACE"}
# Marks of the private-use area as characters, for bullets in text and for those in placed lines (two tables that differ in places).
BULLETS = {0xF06C: "●", 0xF06E: "■", 0xF075: "◆", 0xF0B7: "●", 0xF09F: "●", 0xF077: "◆", 0xF0A7: "■", 0xF0A8: "◆", 0xF046: "☞", 0xF06F: "□", 0xF076: "❖", 0xF0A1: "◯", 0xF0A4: "⊙", 0xF0AB: "★", 0xF0FC: "✓", 0xF0FE: "☑"}
PLACED_BULLETS = {0xF046: "★", 0xF06C: "●", 0xF06E: "●", 0xF06F: "□", 0xF070: "■", 0xF071: "■", 0xF0A7: "■", 0xF075: "◆", 0xF076: "◆", 0xF077: "◇", 0xF0A1: "☞", 0xF0A4: "⊙", 0xF0AB: "❖", 0xF0F0: "✓", 0xF0FC: "✓", 0xF0FE: "☑"}
# Code points that take a full cell: Hangul, ideographs, kana, and their punctuation.
FULL_WIDTH = "[\\x{1100}-\\x{11FF}\\x{3000}-\\x{303F}\\x{3040}-\\x{30FF}\\x{3130}-\\x{318F}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FF01}-\\x{FF60}]"
# Widths of marker characters in mm at 10 pt, by class; file types by extension.
MARKER_WIDTHS = (("[●◆■□◈○]", 5.29), ("[I]", 1.74), ("[.]", 1.46), ("[()]", 1.75), ("[VXABCD]", 3.46), ("[\\x00-\\x7F]", 3.44))
WIDE_MARKER = 4.86
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "wmf": "image/x-wmf", "emf": "image/x-emf"}


def html_escape(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def html_unescape(t: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def visible_spaces(t: Column) -> Column:
    """Leading spaces, each space after another, and a last space become &nbsp;."""
    lead = F.length(t) - F.length(F.ltrim(t))
    rest = F.regexp_replace(F.ltrim(t), "(?<= ) ", "&nbsp;")
    rest = F.regexp_replace(rest, " $", "&nbsp;")
    return F.concat(F.repeat(F.lit("&nbsp;"), lead), rest)


def strip_images(md: Column) -> Column:
    return F.regexp_replace(md, "!\\[[^\\]]*\\]\\([^)]*\\)", "")


def strip_links(md: Column) -> Column:
    """Removes images, then links with their text."""
    return F.regexp_replace(strip_images(md), "\\[[^\\]]*\\]\\([^)]*\\)", "")


def plain_cell(md: Column) -> Column:
    return F.replace(F.translate(F.replace(md, F.lit("~~"), F.lit("")), "\t*", ""), F.lit("\n"), F.lit("<br> "))


def full_width_count(t: Column) -> Column:
    return F.length(t) - F.length(F.regexp_replace(t, FULL_WIDTH, ""))


def marker_width(t: Column, points: float | Column = 10.0) -> Column:
    """Width of a list marker in mm: each character's width, by class; bullets grow with the font size."""
    size = points if isinstance(points, Column) else F.lit(float(points))
    left, total = t, F.lit(0.0)
    for k, (pattern, mm) in enumerate(MARKER_WIDTHS):
        rest = F.regexp_replace(left, pattern, "")
        total = total + (F.length(left) - F.length(rest)) * F.lit(mm) * (size / 10.0 if k == 0 else F.lit(1.0))
        left = rest
    return F.round((total + F.length(left) * F.lit(WIDE_MARKER)) * 100, 0) / 100


def control_class(code: Column) -> Column:
    """char, inline or extended."""
    return F.when(code.isin(*CONTROL_SINGLE), F.lit("char")).when(code.isin(*CONTROL_INLINE), F.lit("inline")).otherwise(F.lit("extended"))


def control_units(code: Column) -> Column:
    return F.when((code > 31) | code.isin(*CONTROL_SINGLE), F.lit(1)).otherwise(F.lit(8)).cast("long")


def control_name(code: Column) -> Column:
    named = F.element_at(F.create_map(*(F.lit(x) for k, v in CONTROL_NAMES.items() for x in (k, v))), code.cast("int"))
    return F.coalesce(named, F.when(code <= 31, F.concat(F.lit("RESERVED_"), code.cast("string"))), F.concat(F.lit("UNKNOWN_"), code.cast("string")))


def bullet_mark(mark: Column, placed: bool = False) -> Column:
    """A bullet as it is shown: private-use marks as characters, any other as it is, none as a dot."""
    table = PLACED_BULLETS if placed else BULLETS
    shown = mark
    for code, c in table.items():
        shown = F.when(mark == chr(code), F.lit(c)).otherwise(shown)
    return F.when(F.coalesce(mark, F.lit("")) == "", F.lit("●")).otherwise(shown)


def attribute_escape(t: Column) -> Column:
    return html_escape(t)


def font_escape(t: Column) -> Column:
    """A font name inside single quotes of a style."""
    return F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def is_block(t: Column) -> Column:
    """Whether a piece of Markdown stands alone: a picture, a table or a rule."""
    return t.startswith("![") | t.startswith("|") | t.startswith("---")


def separator(before: Column, after: Column) -> Column:
    """What joins two pieces of Markdown: a soft break between texts, a blank line beside blocks."""
    text = lambda t: ~t.startswith("\n") & ~is_block(t)
    return F.when(text(before) & text(after), F.lit("  \n")).otherwise(F.lit("\n\n"))


def link_markdown(before: Column, text: Column, url: Column) -> Column:
    """[text](url), its address where it has no text; plain text where the link begins inside a word."""
    inside = F.coalesce(before, F.lit("")).rlike("[\\p{L}\\p{N}]$") & text.rlike("^[\\p{L}\\p{N}]")
    return F.when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("["), url, F.lit("]("), url, F.lit(")"))).when(inside, text).otherwise(F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")")))


def caption_parts(text: Column, number_at: Column, shown: Column, table_number: Column) -> Column:
    """label, number and body of a caption. number_at: place of its automatic number (null for none); shown: that number as it is shown."""
    known = F.coalesce(shown, table_number.cast("string"), F.lit(""))
    at = number_at.cast("int")
    label = F.trim(F.substring(text, F.lit(1), at))
    marked = F.struct(F.when(label == "", F.lit("표")).otherwise(label).alias("label"), known.alias("number"), F.trim(F.substring(text, at + 2, F.length(text))).alias("body"))
    bare = F.trim(text)
    rest = F.when(bare.startswith("표 "), F.substring(bare, F.lit(3), F.length(bare))).otherwise(bare)
    digits = F.regexp_extract(rest, "^([0-9\\s]*)", 1)
    named = F.struct(F.lit("표").alias("label"), F.when(F.length(digits) > 0, F.trim(digits)).otherwise(F.coalesce(table_number.cast("string"), F.lit(""))).alias("number"), F.trim(F.substring(rest, F.length(digits) + 1, F.length(rest))).alias("body"))
    plain = F.struct(F.lit("").alias("label"), known.alias("number"), bare.alias("body"))
    return F.when(number_at.isNotNull(), marked).when(bare.startswith("표"), named).otherwise(plain)


def image_url(data: Column, mime: Column, name: Column, folder: str | None = None) -> Column:
    """Where a picture is shown from: a file of a folder (relative to the page), else the data themselves; empty without data."""
    shown = F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), name) if folder is not None else data_uri(data, mime)
    return F.when(data.isNull() | (F.octet_length(data) == 0), F.lit("")).otherwise(shown)


def preview_format(data: Column) -> Column:
    """BMP, GIF or UNKNOWN, by the first bytes."""
    return F.when(F.hex(F.substring(data, 1, 2)) == "424D", F.lit("BMP")).when(F.hex(F.substring(data, 1, 6)).isin("474946383761", "474946383961"), F.lit("GIF")).otherwise(F.lit("UNKNOWN"))


def markdown_style(t: Column, bold: Column, italic: Column, strike: Column) -> Column:
    """Italic inside bold inside strike; white space alone stays bare."""
    wrap = lambda x, on, mark: F.when(on, F.concat(F.lit(mark), x, F.lit(mark))).otherwise(x)
    return F.when(F.trim(t) == "", t).otherwise(wrap(wrap(wrap(t, italic, "*"), bold, "**"), strike, "~~"))


def html_style(t: Column, bold: Column, italic: Column, strike: Column) -> Column:
    wrap = lambda x, on, tag: F.when(on, F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))).otherwise(x)
    return wrap(wrap(wrap(html_escape(t), italic, "em"), bold, "strong"), strike, "del")


def command_to_url(command: Column) -> Column:
    """target|...;type;...: 0 bookmark, 1 address, 2 mail, 3 file; null for any other."""
    parts = F.split(command, ";")
    target = F.split(parts[0], "\\|")[0]
    for a, b in (("\\:", ":"), ("\\?", "?"), ("\\\\", "\\")):
        target = F.replace(target, F.lit(a), F.lit(b))
    kind = F.when(F.size(parts) >= 2, parts[1])
    mail = F.when(target.startswith("mailto:"), target).otherwise(F.concat(F.lit("mailto:"), target))
    return F.when(kind == "1", target).when(kind == "2", mail).when(kind == "0", F.concat(F.lit("#"), target)).when(kind == "3", F.lit("file://"))


def url_to_onclick(url: Column) -> Column:
    window = F.concat(F.lit("window.open('"), url, F.lit("', '_newtab')"))
    place = F.concat(F.lit("location.href='"), url, F.lit("'"))
    return (
        F.when(url == "", F.lit("")).when(url.startswith("mailto:"), place).when(url.startswith("#"), F.lit("location.href='#'"))
        .when(url.startswith("file://") | url.startswith("/"), F.lit("location.href='file://'")).otherwise(window)
    )


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))


def media_type(ext: Column) -> Column:
    """By extension; image/jpeg where unknown."""
    out = F.when(ext == "png", F.lit(MEDIA["png"]))
    for e, m in MEDIA.items():
        out = out.when(ext == e, F.lit(m))
    return out.otherwise(F.lit("image/jpeg"))


def data_uri(data: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), "[\\r\\n]", ""))


def detect_format(content: Column) -> Column:
    """compound, package or unknown, by the first bytes."""
    return F.when(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1", F.lit("compound")).when(F.hex(F.substring(content, 1, 4)) == "504B0304", F.lit("package")).otherwise(F.lit("unknown"))
