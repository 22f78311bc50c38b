"""Table grids: cover of merged cells, zones, positions, Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.text import html_escape


def ordered(order: list[str], value: str, sep: str):
    """The values of a group, joined in the given order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]), sep)


def covered_slots(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every slot a cell covers: row, col, and whether it is the cell's own (origin)."""
    rows = F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)
    cols = F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)
    slots = cells.select(*keys, "row", "col", F.explode(rows).alias("r"), cols.alias("_cols"))
    slots = slots.select(*keys, "row", "col", "r", F.explode("_cols").alias("c"))
    return slots.select(*keys, F.col("r").alias("slot_row"), F.col("c").alias("slot_col"), ((F.col("r") == F.col("row")) & (F.col("c") == F.col("col"))).alias("origin"))


def grid_positions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Row heights (largest of the cells that span one row) and where each row begins."""
    heights = cells.groupBy(*keys, "row").agg(F.max(F.when(F.col("row_span") <= 1, F.col("height"))).alias("height")).withColumn("height", F.coalesce("height", F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return heights.withColumn("top", F.coalesce(F.sum("height").over(before), F.lit(0)))


def markdown_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """| a | b | lines with a rule below the first; empty slots stay empty. cells: row, col, text; the width is the table's largest col + 1.

    One aggregation on the table's key; the grid is made of its sorted cells."""
    cell = F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.coalesce("text", F.lit("")).alias("text"))
    held = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    # Of cells that claim one slot the first counts.
    fresh = lambda x, i: (i == 0) | (F.get("_cells", i - 1)["row"] != x["row"]) | (F.get("_cells", i - 1)["col"] != x["col"])
    held = held.withColumn("_cells", F.filter("_cells", fresh))
    width = F.array_max(F.transform("_cells", lambda x: x["col"])) + 1
    held = held.withColumn("_width", width.cast("int")).withColumn("_rows", F.array_distinct(F.transform("_cells", lambda x: x["row"]))).withColumn("_at", F.map_from_entries(F.transform("_cells", lambda x: F.struct(x["row"] * F.col("_width") + x["col"], x["text"]))))
    slots = lambda r: F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda c: F.coalesce(F.element_at("_at", r * F.col("_width") + c), F.lit("")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(slots(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("_width")))
    lines = F.transform("_rows", lambda r, i: F.concat(line(r), F.when(i == 0, rule).otherwise(F.lit(""))))
    return held.select(*keys, F.array_join(lines, "\n").alias("markdown"))


def html_table(cells: DataFrame, keys: list[str], escape: bool = True, css: str = "") -> DataFrame:
    """<table> of rows and cells with spans. cells: row, col, row_span, col_span, text, and style where there is one; one aggregation on the table's key."""
    span = lambda name: F.when(F.col(f"{name}_span") > 1, F.concat(F.lit(f' {name}span="'), F.col(f"{name}_span").cast("string"), F.lit('"'))).otherwise(F.lit(""))
    style = F.when(F.coalesce("style", F.lit("")) != "", F.concat(F.lit(' style="'), "style", F.lit('"'))).otherwise(F.lit("")) if "style" in cells.columns else F.lit("")
    text = html_escape(F.col("text")) if escape else F.col("text")
    td = F.concat(F.lit("<td"), span("row"), span("col"), style, F.lit(">"), F.coalesce(text, F.lit("")), F.lit("</td>"))
    held = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("row").alias("row"), F.col("col").alias("col"), td.alias("td")))).alias("_cells"))
    opens = lambda x, i: (i == 0) | (F.get("_cells", i - 1)["row"] != x["row"])
    closes = lambda x, i: (i == F.size("_cells") - 1) | (F.get("_cells", i + 1)["row"] != x["row"])
    pieces = F.transform("_cells", lambda x, i: F.concat(F.when(opens(x, i), F.lit("<tr>")).otherwise(F.lit("")), x["td"], F.when(closes(x, i), F.lit("</tr>")).otherwise(F.lit(""))))
    tag = f'<table class="{css}">' if css else "<table>"
    return held.select(*keys, F.concat(F.lit(tag), F.array_join(pieces, ""), F.lit("</table>")).alias("html"))


def thicker(a: Column, b: Column) -> Column:
    """Of two borders (structs of line, width, colour) the visible one, of two visible ones the thicker, of equals the first; null where there is none."""
    gone = lambda x: x["line"] == 0
    return F.when(a.isNull(), b).when(b.isNull(), a).when(gone(a) & gone(b), a).when(gone(a), b).when(gone(b), a).when(b["width"] > a["width"], b).otherwise(a)


def grid_borders(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind (v or h), row, col, line, width, colour of every visible grid line: slot by slot, of the two cells beside it the thicker border; at the table's edge the
    thicker of the cell's and the table's; inside, the table's where the cells' has no width.

    cells: row, col, row_span, col_span, left, right, top, bottom (structs of line, width, colour) and table (a struct of the same four, null without). One row for a line's slot:
    v lines stand left of column col, h lines above row row."""
    edge = lambda kind, row, col, border, first: F.struct(F.lit(kind).alias("kind"), row.cast("long").alias("row"), col.cast("long").alias("col"), border.alias("border"), F.lit(first).alias("first"))
    r, c, rs, cs = (F.col(x) for x in ("row", "col", "row_span", "col_span"))
    down, across = F.sequence(r, r + F.greatest(rs, F.lit(1)) - 1), F.sequence(c, c + F.greatest(cs, F.lit(1)) - 1)
    edges = F.concat(
        F.transform(down, lambda y: edge("v", y, c, F.col("left"), 1)), F.transform(down, lambda y: edge("v", y, c + F.greatest(cs, F.lit(1)), F.col("right"), 0)),
        F.transform(across, lambda x: edge("h", r, x, F.col("top"), 1)), F.transform(across, lambda x: edge("h", r + F.greatest(rs, F.lit(1)), x, F.col("bottom"), 0)),
    )
    size = cells.groupBy(*keys).agg(F.max(r + F.greatest(rs, F.lit(1))).alias("_rows"), F.max(c + F.greatest(cs, F.lit(1))).alias("_cols"), F.first("table").alias("_table"))
    sides = cells.select(*keys, F.explode(edges).alias("e")).select(*keys, "e.*")
    # first = 0: the border of the cell before the line (its right or bottom), which wins ties.
    both = sides.groupBy(*keys, "kind", "row", "col").agg(F.max(F.when(F.col("first") == 0, F.col("border"))).alias("a"), F.max(F.when(F.col("first") == 1, F.col("border"))).alias("b"), F.count("*").alias("n")).join(size, keys)
    own = thicker(F.col("a"), F.col("b"))
    at_start = F.when(F.col("kind") == "v", F.col("col") == 0).otherwise(F.col("row") == 0)
    at_end = F.when(F.col("kind") == "v", F.col("col") == F.col("_cols")).otherwise(F.col("row") == F.col("_rows"))
    t = F.col("_table")
    default = F.when(F.col("kind") == "v", F.when(at_end, t["right"]).otherwise(t["left"])).otherwise(F.when(at_end, t["bottom"]).otherwise(t["top"]))
    strong = default.isNotNull() & (default["line"] != 0) & (default["width"] != 0)
    outer = F.when(own.isNull(), default).when(own["line"] == 0, F.lit(None)).when(strong & (own["width"] < default["width"]), default).otherwise(own)
    inner = F.when(own.isNull(), default).when(own["line"] == 0, F.lit(None)).when(own["width"] == 0, F.coalesce(default, own)).otherwise(own)
    found = both.withColumn("border", F.when(at_start | at_end, outer).otherwise(inner)).where("border is not null and border.line <> 0")
    return found.select(*keys, "kind", "row", "col", "border.line", "border.width", "border.colour")


def column_positions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Column widths (largest of the cells that span one column) and where each column begins."""
    widths = cells.groupBy(*keys, "col").agg(F.max(F.when(F.col("col_span") <= 1, F.col("width"))).alias("width")).withColumn("width", F.coalesce("width", F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    return widths.withColumn("left", F.coalesce(F.sum("width").over(before), F.lit(0)))


def zone_fill(cells: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """The fill of each cell: of the last zone with a fill that holds it, else its own, else the table's."""
    held = cells.join(zones, keys).where("row between top and bottom and col between left and right and zone_fill <> 0")
    last = held.groupBy(*keys, "row", "col").agg(F.max_by("zone_fill", "zone_ord").alias("_zone"))
    return cells.join(last, [*keys, "row", "col"], "left").withColumn("fill", F.coalesce("_zone", F.when(F.col("cell_fill") != 0, F.col("cell_fill")), F.col("table_fill"))).drop("_zone")
