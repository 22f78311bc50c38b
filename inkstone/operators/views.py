"""Views over decoded files: links, pictures, equations, automatic numbers, page geometry, and a summary of each file.

They take the tables of inkstone.sources.documents.read_table. Fields of records are JSON and are read by path, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import numbering as N
from inkstone.functions import text as X
from inkstone.functions.values import CONTROL_MARKS, border_mm, colour_hex, field, page_size, round2, unit_to_mm
from inkstone.operators import render
from inkstone.operators.inline import automatic_numbers as automatic_in_text
from inkstone.operators.layout import SHEET, content
from inkstone.operators.sequences import numbers_with_reset
from inkstone.operators.tables import column_positions, grid_borders, grid_positions, ordered
from inkstone.sources.records import NUMBER_KINDS


def json_field(name: str, kind: str = "string") -> Column:
    return F.get_json_object("fields", f"$.{name}").cast(kind)


def links(records: DataFrame) -> DataFrame:
    """file, stream, seq, url of every hyperlink field."""
    found = records.where("name = 'field'").where(json_field("control") == "%hlk")
    return found.select("file", "stream", "seq", X.command_to_url(json_field("command")).alias("url")).where("url is not null")


def package_links(elements: DataFrame) -> DataFrame:
    """file, part, seq, url of every hyperlink of packages: the Command parameter of a field, else its name."""
    begins = elements.where("name = 'fieldBegin'").where(F.get_json_object("attributes", "$.type") == "HYPERLINK").select("file", "part", F.col("seq").alias("field"), F.get_json_object("attributes", "$.name").alias("label"))
    lists = elements.where("name = 'parameters'").select("file", "part", F.col("seq").alias("list"), F.col("parent").alias("field"))
    values = elements.where("name = 'stringParam'").where(F.get_json_object("attributes", "$.name") == "Command").select("file", "part", F.col("parent").alias("list"), "text")
    commands = lists.join(values, ["file", "part", "list"]).groupBy("file", "part", "field").agg(F.min("text").alias("command"))
    return begins.join(commands, ["file", "part", "field"], "left").select("file", "part", F.col("field").alias("seq"), F.coalesce(X.command_to_url(F.col("command")), "label").alias("url")).where("url is not null")


def pictures(records: DataFrame, binaries: DataFrame) -> DataFrame:
    """file, stream, seq, bin_id, mime of every picture; image/jpeg where the part is missing."""
    used = records.where("name = 'picture'").select("file", "stream", "seq", F.format_string("BIN%04X", json_field("bin_item", "int")).alias("bin_id"))
    parts = binaries.select("file", F.col("id").alias("bin_id"), "format")
    return used.join(parts, ["file", "bin_id"], "left").select("file", "stream", "seq", "bin_id", X.media_type(F.coalesce("format", F.lit("jpg"))).alias("mime"))


def equations(records: DataFrame) -> DataFrame:
    return records.where("name = 'equation'").where(json_field("script").isNotNull()).select("file", "stream", "seq", json_field("script").alias("script"))


def automatic_numbers(records: DataFrame) -> DataFrame:
    """file, stream, seq, kind, n, text: running numbers of each kind through a file; a new-number control sets the next."""
    found = records.where("name in ('auto_number', 'new_number')").withColumn("attribute", json_field("attribute", "long"))
    kind = F.coalesce(F.get(F.array(*map(F.lit, NUMBER_KINDS)), field(F.col("attribute"), 0, 4).cast("int")), F.lit("unknown"))
    rows = found.withColumn("kind", kind).withColumn("pos", F.struct("stream", "seq"))
    reset = F.col("name") == "new_number"
    numbered = numbers_with_reset(rows, ["file", "kind"], "pos", reset, json_field("number", "long"), ~reset).where(~reset)
    return numbered.select("file", "stream", "seq", "kind", "n", N.by_shape(field(F.col("attribute"), 4, 8), F.col("n")).alias("text"))


def page_geometry(pages: DataFrame) -> DataFrame:
    """The first page definition of each section: sizes as turned, and the content's box."""
    first = pages.groupBy("file", "section").agg(F.min(F.struct(*SHEET)).alias("s")).withColumn("size", page_size(F.col("s.width"), F.col("s.height"), F.col("s.landscape"))).withColumn("box", content())
    return first.select("file", "section", "size.width", "size.height", F.col("box.left").alias("content_left"), F.col("box.top").alias("content_top"), F.col("box.width").alias("content_width"), F.col("box.height").alias("content_height"))


def section_of(path: str = "path") -> Column:
    return F.substring_index(path, ".", 1).cast("long")


def column_definitions(controls: DataFrame) -> DataFrame:
    """file, section, kind, columns, gap of the first column definition of each section."""
    found = controls.where("kind = 'cold'").groupBy("file", section_of().alias("section")).agg(F.min_by("fields", "path").alias("fields"))
    bits = json_field("attribute", "long")
    kind = F.coalesce(F.get(F.array(*map(F.lit, ("normal", "distributed", "parallel"))), bits.bitwiseAND(3).cast("int")), F.lit("normal"))
    count = F.greatest(field(bits, 2, 8), F.lit(1))
    return found.select("file", "section", F.coalesce(kind, F.lower(json_field("type"))).alias("kind"), F.coalesce(count, json_field("colCount", "long")).alias("columns"), F.coalesce(json_field("gap", "long"), json_field("sameGap", "long")).alias("gap"))


def outline_ids(controls: DataFrame) -> DataFrame:
    """file, section, outline: the numbering that the section's headings use, null for 0."""
    found = controls.where("kind = 'secd'").groupBy("file", section_of().alias("section")).agg(F.min_by("fields", "path").alias("fields"))
    return found.select("file", "section", F.nullif(F.coalesce(json_field("numbering", "long"), json_field("outlineShapeIDRef", "long")), F.lit(0)).alias("outline"))


def start_numbers(settings: DataFrame) -> DataFrame:
    """The six start numbers of a file, 1 where they aren't given."""
    names = ("page_start", "footnote_start", "endnote_start", "picture_start", "table_start", "equation_start")
    return settings.select("file", *(F.coalesce(n, F.lit(1)).alias(n) for n in names))


def metadata(meta: DataFrame) -> DataFrame:
    """file, title, creator, description, keywords, subject: one row a file; empty values are null."""
    first = lambda k: F.max(F.when(F.col("key") == k, F.nullif(F.col("value"), F.lit("")))).alias(k)
    return meta.groupBy("file").agg(*(first(k) for k in ("title", "creator", "description", "keywords", "subject")))


def large_lines(segments: DataFrame, mm: float = 10.0) -> DataFrame:
    """file, path, large: whether a paragraph has a line taller than mm."""
    return segments.groupBy("file", "path").agg(F.bool_or(unit_to_mm(F.col("height")) > mm).alias("large"))


def files_with_lines(paragraphs: DataFrame, segments: DataFrame) -> DataFrame:
    """file, has_lines: whether any paragraph of a file has line segments."""
    held = segments.select("file", "path", F.lit(True).alias("some")).distinct()
    return paragraphs.join(held, ["file", "path"], "left").groupBy("file").agg(F.bool_or(F.coalesce("some", F.lit(False))).alias("has_lines"))


def shape_sizes(records: DataFrame) -> DataFrame:
    """file, stream, shapes, tallest, widest of the drawn objects of each stream."""
    found = records.where("name = 'shape_component'")
    return found.groupBy("file", "stream").agg(F.count("*").alias("shapes"), F.max(json_field("height", "long")).alias("tallest"), F.max(json_field("width", "long")).alias("widest"))


def table_sizes(cells: DataFrame) -> DataFrame:
    """file, table, width, height: what the rows and columns of a table add up to."""
    rows = grid_positions(cells, ["file", "table"]).groupBy("file", "table").agg(F.sum("height").alias("height"))
    cols = column_positions(cells, ["file", "table"]).groupBy("file", "table").agg(F.sum("width").alias("width"))
    return cols.join(rows, ["file", "table"])


def table_borders(tables: dict[str, DataFrame]) -> DataFrame:
    """file, table, kind, row, col, line, width, colour of the visible grid lines. tables: cells, tables, zones, border_fills."""
    side = lambda s: F.struct(*(F.col(f"{s}_{k}").alias(k) for k in ("line", "width", "colour")))
    known = lambda s: F.when(F.col(f"{s}_line").isNotNull(), side(s))
    fills = tables["border_fills"].select("file", "id", *(known(s).alias(s) for s in ("left", "right", "top", "bottom")))
    cells = tables["cells"].join(render.cell_fills(tables).withColumnRenamed("fill_id", "id"), ["file", "path"], "left").join(fills, ["file", "id"], "left")
    whole = fills.select("file", F.col("id").alias("table_id"), F.struct("left", "right", "top", "bottom").alias("table_sides"))
    own = tables["tables"].select("file", F.col("path").alias("table"), F.col("border_fill").alias("table_id")).join(whole, ["file", "table_id"], "left")
    cells = cells.join(own.select("file", "table", "table_sides"), ["file", "table"], "left")
    return grid_borders(cells.select("file", F.col("table").alias("of"), "row", "col", "row_span", "col_span", "left", "right", "top", "bottom", F.col("table_sides").alias("table")), ["file", "of"]).withColumnRenamed("of", "table")


def table_svg(tables: dict[str, DataFrame]) -> DataFrame:
    """file, table, svg: a table's grid lines as one drawing; equal lines that touch are one path."""
    keys = ["file", "table"]
    x, y = column_positions(tables["cells"], keys), grid_positions(tables["cells"], keys)
    lines = table_borders(tables)
    along = F.when(F.col("kind") == "v", F.col("row")).otherwise(F.col("col"))
    across = F.when(F.col("kind") == "v", F.col("col")).otherwise(F.col("row"))
    look = ["line", "width", "colour"]
    run = along - F.row_number().over(Window.partitionBy(*keys, "kind", across, *look).orderBy(along))
    merged = lines.withColumn("along", along).withColumn("across", across).withColumn("run", run).groupBy(*keys, "kind", "across", "run", *look).agg(F.min("along").alias("a"), F.max("along").alias("b"))
    start = x.select(*keys, F.lit("x").alias("axis"), F.col("col").cast("long").alias("k"), F.col("left").cast("long").alias("from"), (F.col("left") + F.col("width")).cast("long").alias("to")).unionByName(y.select(*keys, F.lit("y").alias("axis"), F.col("row").cast("long").alias("k"), F.col("top").cast("long").alias("from"), (F.col("top") + F.col("height")).cast("long").alias("to")))
    places = start.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("axis", F.col("k").cast("string")), F.struct("from", "to")))).alias("at"))
    found = merged.join(places, keys)
    place = lambda axis, k, end: F.coalesce(F.element_at("at", F.concat(F.lit(axis), k.cast("string")))[end], F.element_at("at", F.concat(F.lit(axis), (k - 1).cast("string")))["to"], F.lit(0))
    mm = lambda u: F.format_string("%.2f", round2(unit_to_mm(u)))
    d = F.when(F.col("kind") == "v", F.concat(F.lit("M"), mm(place("x", F.col("across"), "from")), F.lit(","), mm(place("y", F.col("a"), "from")), F.lit("V"), mm(place("y", F.col("b"), "to")))).otherwise(F.concat(F.lit("M"), mm(place("x", F.col("a"), "from")), F.lit(","), mm(place("y", F.col("across"), "from")), F.lit("H"), mm(place("x", F.col("b"), "to"))))
    path = F.concat(F.lit('<path d="'), d, F.lit('" style="stroke:'), colour_hex(F.coalesce("colour", F.lit(0))), F.lit(";stroke-width:"), F.format_string("%.2f", border_mm(F.col("width"))), F.lit('"/>'))
    return found.withColumn("path", path).groupBy(*keys).agg(F.concat(F.lit("<svg>"), ordered(["kind", "across", "a"], "path", ""), F.lit("</svg>")).alias("svg"))


def caption_texts(tables: dict[str, DataFrame]) -> DataFrame:
    """file, control, side, label, number, body of each table's caption. tables: captions, runs, controls (settings, note_shapes)."""
    numbers = automatic_in_text(tables["controls"], tables.get("settings"), tables.get("note_shapes")).select("file", F.col("path").alias("number_control"), "shown")
    held = tables["runs"].withColumn("container", F.regexp_extract("path", "^(.*)\\.[0-9]+$", 1)).join(tables["captions"].select("file", F.col("path").alias("container"), F.col("control").alias("of"), "side"), ["file", "container"])
    pieces = held.join(numbers, (held.file == numbers.file) & (held.control == numbers.number_control), "left").select(held.file, "of", "side", held.path, "ord", F.when(F.col("kind") == "text", F.col("text")).otherwise(F.lit("")).alias("text"), "shown")
    before = Window.partitionBy("file", "of").orderBy("path", "ord").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    flat = pieces.withColumn("at", F.when(F.col("shown").isNotNull(), at)).withColumn("piece", F.when(F.col("shown").isNotNull(), F.lit("\ufffc")).otherwise(F.col("text")))
    whole = flat.groupBy("file", "of", "side").agg(ordered(["path", "ord"], "piece", "").alias("text"), F.min("at").alias("at"), F.min_by("shown", F.when(F.col("shown").isNotNull(), F.struct("path", "ord"))).alias("shown"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("of"))
    return whole.withColumn("parts", X.caption_parts(F.col("text"), F.col("at"), F.col("shown"), rank)).select("file", F.col("of").alias("control"), "side", "parts.*")


def held_by_controls(paragraphs: DataFrame, controls: DataFrame, kinds: tuple[str, ...] = ("head", "foot", "fn  ", "en  ")) -> DataFrame:
    """Paragraphs inside headers, footers and notes."""
    owners = controls.where(F.col("kind").isin(*kinds)).select("file", F.col("path").alias("owner"))
    return paragraphs.withColumn("owner", F.regexp_extract("container", "^(.*\\.c[0-9]+)\\.", 1)).join(owners, ["file", "owner"], "left_semi").drop("owner")


def with_marks(paragraphs: DataFrame, names: tuple[str, ...] = ("header_footer", "footnote_endnote")) -> DataFrame:
    """Paragraphs whose control mask has one of the marks: a filter before anything else of them is looked at."""
    bits = sum(1 << b for b, n in CONTROL_MARKS.items() if n in names)
    return paragraphs.where(F.col("mask").bitwiseAND(bits) != 0)


def missing_references(facts: DataFrame, key: str, dimension: DataFrame) -> DataFrame:
    """Rows whose key has no row in a dimension: none in a sound file."""
    return facts.join(dimension.select("file", F.col("id").alias(key)), ["file", key], "left_anti")


def info(tables: dict[str, DataFrame]) -> DataFrame:
    """file, version, format, sections, paragraphs, images of each file."""
    counts = tables["paragraphs"].groupBy("file").agg(F.countDistinct("section").alias("sections"), F.count("*").alias("paragraphs"))
    images = tables["binaries"].where(F.col("format").isin(*X.MEDIA)).groupBy("file").agg(F.count("*").alias("images"))
    return tables["headers"].select("file", "version", "format").join(counts, "file", "left").join(images, "file", "left").na.fill(0, ["sections", "paragraphs", "images"])
