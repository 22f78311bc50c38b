"""Page layout: the pages of paragraphs by their line positions, and absolutely placed lines as HTML.

Pagination is a fold over the paragraphs of a section in order; sections are rows, so they fold in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import full_width_count, html_escape, visible_spaces
from inkstone.functions.values import content_box, mm_text, page_size, round2, unit_to_mm
from inkstone.operators.sequences import fold_rows, ranges
from inkstone.operators.tables import ordered

#: Positions nearer than this count as equal; a reset must land in the top fifth of the page.
NEAR_MM, TOP_SHARE = 0.1, 0.2


def paginate(paragraphs: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """keys, pos, page, reason. paragraphs: page_break, first, last, bottom (mm from the section's start, null without lines), content_height; optionally
    sheet (what the page's definition says) and object_bottom (the deepest edge of a table or drawing, mm from the section's start).

    A page ends before a paragraph that asks for it (explicit), whose page definition is another (sheet), whose position falls back to the top (reset), or that
    begins or ends below the content (overflow), or whose objects do (object), of a page that holds something. A reset moves the origin of positions to the
    paragraph's last line."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        page, held, before, deepest, origin, sheet = state
        asked, first, last, bottom, height, own_sheet, objects = row
        reason = None
        at = None if first is None else first - origin
        end = None if bottom is None else bottom - origin
        if asked:
            reason = "explicit"
        elif own_sheet is not None and sheet is not None and own_sheet != sheet:
            reason = "sheet"
        elif before is not None and at is not None and (at < NEAR_MM or (before > NEAR_MM and at < before - NEAR_MM)) and (at < NEAR_MM or at < height * TOP_SHARE):
            reason = "reset"
        elif deepest > 0 and ((at is not None and at > height) or (end is not None and end > height)):
            reason = "overflow"
        elif deepest > 0 and objects is not None and objects - origin > height:
            reason = "object"
        breaks = reason is not None and held > 0
        if breaks:
            page, held, deepest = page + 1, 0, 0.0
            if reason == "reset" and last is not None:
                origin = last
        place = None if last is None else last - origin
        before = before if place is None else place
        deepest = max(deepest, place if place is not None else deepest)
        return (page, held + 1, before, deepest, origin, own_sheet if own_sheet is not None else sheet), (page, reason if breaks else None)

    given = {"page_break": F.coalesce("page_break", F.lit(False)), "sheet": F.lit(None).cast("string"), "object_bottom": F.lit(None).cast("double")}
    rows = paragraphs.select(*keys, pos, *(F.col(c).cast("double").alias(c) for c in ("first", "last", "bottom", "content_height")), *(F.col(c).cast(k).alias(c) if c in paragraphs.columns else v.alias(c) for (c, v), k in zip(given.items(), ("boolean", "string", "double"), strict=True)))
    return fold_rows(rows, keys, pos, ["page_break", "first", "last", "bottom", "content_height", "sheet", "object_bottom"], lambda: (1, 0, None, 0.0, 0.0, None), step, "page bigint, reason string")


def line_texts(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """file, path, segment, top, height, text: each line's part of its paragraph's text. Lines flagged empty (bit 16) are left out."""
    flat = runs.where("kind = 'text'").groupBy("file", "path").agg(ordered(["ord"], "text", "").alias("text"))
    cut = ranges(segments.join(flat, ["file", "path"]), ["file", "path"], "segment", "start", F.length("text").cast("long"))
    lines = cut.where(F.col("flags").bitwiseAND(1 << 16) == 0)
    return lines.select("file", "path", "segment", "top", "height", F.expr("substring(text, cast(start as int) + 1, cast(greatest(`end` - start, 0) as int))").alias("text"))


def text_spans(runs: DataFrame) -> DataFrame:
    """file, path, start, char_shape: where each style begins in its paragraph's text."""
    before = Window.partitionBy("file", "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    text = runs.where("kind = 'text'")
    return text.select("file", "path", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long").alias("start"), "char_shape")


def segment_styles(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """file, path, segment, char_shape: the last style change at or before each line's start; before the first, the first."""
    marks = text_spans(runs).select("file", "path", "start", F.lit(0).alias("late"), "char_shape", F.lit(None).cast("long").alias("segment"))
    lines = segments.select("file", "path", "start", F.lit(1).alias("late"), F.lit(None).cast("long").alias("char_shape"), "segment")
    upto = Window.partitionBy("file", "path").orderBy("start", "late").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file", "path").orderBy("start", "late").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = marks.unionByName(lines).withColumn("char_shape", F.coalesce(F.last("char_shape", ignorenulls=True).over(upto), F.first("char_shape", ignorenulls=True).over(whole)))
    return found.where("segment is not null").select("file", "path", "segment", "char_shape")


def boundaries(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """file, path, places: every place where a style or a line begins, once, in order."""
    places = text_spans(runs).select("file", "path", "start").unionByName(segments.select("file", "path", "start"))
    return places.groupBy("file", "path").agg(F.array_sort(F.collect_set("start")).alias("places"))


def synthetic_segments(paragraphs: DataFrame, runs: DataFrame, pages: DataFrame, segments: DataFrame, height: int = 1000, gap: int = 600) -> DataFrame:
    """Line segments for files that have none at all: lines of as many cells as the content is wide, one below the other through a section.

    A full-width character takes a cell of the text's height, any other half of one. Positions inside a container count from its own start."""
    bare = paragraphs.join(segments.select("file").distinct(), "file", "left_anti").select("file", "path", "section", "container")
    flat = runs.where("kind = 'text'").groupBy("file", "path").agg(ordered(["ord"], "text", "").alias("text"))
    sheet = pages.groupBy("file", "section").agg(F.min_by(F.struct("width", "left", "right", "gutter"), F.struct("width", "left")).alias("s"))
    room = F.greatest(F.coalesce(F.col("s.width") - F.col("s.left") - F.col("s.right") - F.col("s.gutter"), F.lit(42520)), F.lit(height))
    laid = bare.join(flat, ["file", "path"], "left").join(sheet, ["file", "section"], "left").na.fill({"text": ""})
    cells = F.length("text") + full_width_count(F.col("text"))
    laid = laid.withColumn("lines", F.greatest(F.lit(1), F.ceil(cells * (height / 2) / room)).cast("long"))
    before = Window.partitionBy("file", "container").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("from", F.coalesce(F.sum(F.col("lines") * (height + gap)).over(before), F.lit(0)))
    each = laid.select("file", "path", "from", F.length("text").alias("chars"), "lines", room.alias("room"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("lines") - 1)).alias("segment", "k"))
    start = F.floor(F.col("chars") * F.col("k") / F.col("lines")).cast("long")
    return each.select("file", "path", F.col("segment").cast("long").alias("segment"), start.alias("start"), (F.col("from") + F.col("k") * (height + gap)).cast("long").alias("top"), F.lit(height).cast("long").alias("height"), F.lit(gap).cast("long").alias("gap"), F.lit(0).cast("long").alias("left"), F.col("room").cast("long").alias("width"), F.lit(0).cast("long").alias("flags"))


def column_groups(segments: DataFrame, keys: list[str], pos: str, top: str) -> DataFrame:
    """group of each line: a new one begins where a line isn't below the one before it."""
    order = Window.partitionBy(*keys).orderBy(pos)
    fresh = F.when(F.col(top) <= F.lag(top).over(order), 1).otherwise(0)
    return segments.withColumn("_fresh", fresh).withColumn("group", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_fresh")


def assign_columns(blocks: DataFrame, keys: list[str], pos: str, columns: int) -> DataFrame:
    """keys, pos, page, column of each block (top, bottom): the column whose depth is nearest above the block's top, else the first empty one, else the first of a new page."""

    def step(state: tuple[int, list], row: tuple) -> tuple[tuple[int, list], tuple]:
        page, depths = state
        top, bottom = row
        above = [(top - d, k) for k, d in enumerate(depths) if d is not None and d <= top]
        empty = [k for k, d in enumerate(depths) if d is None]
        if above:
            column = min(above)[1]
        elif empty:
            column = empty[0]
        else:
            page, depths, column = page + 1, [None] * columns, 0
        depths = [*depths[:column], bottom, *depths[column + 1 :]]
        return (page, depths), (page, column)

    return fold_rows(blocks, keys, pos, ["top", "bottom"], lambda: (1, [None] * columns), step, "page bigint, column bigint")


def content(sheet: str = "s"):
    """The content's left, top, width and height of a page definition."""
    c = lambda n: F.col(f"{sheet}.{n}")
    return content_box(page_size(c("width"), c("height"), c("landscape")), c("left"), c("right"), c("top"), c("bottom"), c("header"), c("footer"), c("gutter"))


SHEET = ("width", "height", "left", "right", "top", "bottom", "header", "footer", "gutter", "landscape")


def layout_html(tables: dict[str, DataFrame]) -> DataFrame:
    """file, section, page, number, html: one row for each page, with its lines placed from the page's top left, in the style that each begins with, and the page's number.

    tables: paragraphs, runs, line_segments, pages. Files without line segments get synthetic ones."""
    segments = tables["line_segments"]
    segments = segments.unionByName(synthetic_segments(tables["paragraphs"], tables["runs"], tables["pages"], segments))
    mm = lambda c: unit_to_mm(F.col(c))
    spans = segments.groupBy("file", "path").agg(F.min_by("top", "segment").alias("f"), F.max_by("top", "segment").alias("l"), F.max_by(F.col("top") + F.col("height"), "segment").alias("b"))
    sheet = tables["pages"].groupBy("file", "section").agg(F.min(F.struct(*SHEET)).alias("s"))
    paras = tables["paragraphs"].where(~F.col("container").contains(".")).join(spans, ["file", "path"], "left").join(sheet, ["file", "section"]).withColumn("box", content())
    placed = paras.select("file", "section", "path", "page_break", mm("f").alias("first"), mm("l").alias("last"), mm("b").alias("bottom"), unit_to_mm(F.col("box.height")).alias("content_height"), "s", "box")
    paged = paginate(placed.drop("s", "box"), ["file", "section"], "path").join(placed.select("file", "section", "path", "s", "box"), ["file", "section", "path"])
    origin = F.min("top").over(Window.partitionBy("file", "section", "page"))
    styles = segment_styles(tables["runs"], segments)
    lines = line_texts(tables["runs"], segments).join(paged, ["file", "path"]).join(styles, ["file", "path", "segment"], "left")
    lines = lines.withColumn("y", F.col("top") - F.when(F.col("page") > 1, origin).otherwise(F.lit(0)) + F.col("box.top"))
    div = F.concat(F.lit('<div class="line cs-'), F.coalesce(F.col("char_shape"), F.lit(0)).cast("string"), F.lit('" style="left:'), mm_text(unit_to_mm(F.col("box.left"))), F.lit(";top:"), mm_text(round2(mm("y"))), F.lit('">'), visible_spaces(html_escape(F.col("text"))), F.lit("</div>"))
    page = lines.withColumn("div", div).groupBy("file", "section", "page").agg(F.first("s").alias("s"), ordered(["path", "segment"], "div", "").alias("body"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("section", "page")).cast("long")
    size = page_size(F.col("s.width"), F.col("s.height"), F.col("s.landscape"))
    page = page.withColumn("number", number).withColumn("size", size)
    html = F.concat(F.lit('<div class="page" style="width:'), mm_text(mm("size.width")), F.lit(";height:"), mm_text(mm("size.height")), F.lit('">'), "body", F.lit('<div class="number">'), F.col("number").cast("string"), F.lit("</div></div>"))
    return page.select("file", "section", "page", "number", html.alias("html"))
