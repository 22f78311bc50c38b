"""What stands inside a paragraph: styled text, links across runs, pictures, equations, note references, automatic numbers.

Pieces are rows in the order of their paragraph; all joins and windows are on the file and the path of a paragraph or control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import numbering as N
from inkstone.functions import text as X
from inkstone.operators.renderers import Renderer
from inkstone.operators.sequences import numbers_with_reset
from inkstone.operators.tables import ordered

#: Marks of runs that end a field: by code in the binary format, by kind in packages.
FIELD_ENDS = ("control:4", "control:fieldEnd")


def automatic_numbers(controls: DataFrame, settings: DataFrame | None = None, note_shapes: DataFrame | None = None) -> DataFrame:
    """file, path, number_kind, n, shown: running numbers of each kind through a file. A new-number control sets the next; counting begins where
    the settings say; where a section's notes restart, their numbers begin anew in each section."""
    found = controls.where(F.col("kind").isin("atno", "autn", "nwno", "newn")).select("file", "path", "kind", "number", "number_kind", "number_shape", F.substring_index("path", ".", 1).alias("section"))
    begin = F.lit(1).cast("long")
    if settings is not None:
        kinds = {"footnote": "footnote_start", "endnote": "endnote_start", "image": "picture_start", "table": "table_start", "equation": "equation_start"}
        starts = settings.select("file", F.explode(F.create_map(*(x for k, c in kinds.items() for x in (F.lit(k), F.col(c))))).alias("number_kind", "first")).groupBy("file", "number_kind").agg(F.min("first").alias("first"))
        found = found.join(starts, ["file", "number_kind"], "left")
        begin = F.coalesce("first", begin)
    keys, island = ["file", "number_kind"], F.lit("")
    if note_shapes is not None:
        rule = note_shapes.groupBy("file", F.col("kind").alias("number_kind")).agg(F.min_by("restart", F.struct("section", "ord")).alias("restart"))
        found = found.join(rule, ["file", "number_kind"], "left")
        island = F.when(F.col("restart") == "section", F.col("section")).otherwise(F.lit(""))
    reset = F.col("kind").isin("nwno", "newn")
    numbered = numbers_with_reset(found.withColumn("island", island), [*keys, "island"], "path", reset, F.col("number"), ~reset, first=begin).where(~reset)
    return numbered.select("file", "path", "number_kind", "n", N.by_shape(F.col("number_shape"), F.col("n")).alias("shown"))


def note_numbers(controls: DataFrame) -> DataFrame:
    """file, path, kind, n of footnotes and endnotes: their own number, else a running one through the file."""
    notes = controls.where(F.col("kind").isin("fn  ", "en  "))
    running = F.row_number().over(Window.partitionBy("file", "kind").orderBy("path"))
    return notes.select("file", "path", "kind", F.coalesce(F.when(F.col("number") > 0, F.col("number")), running).cast("long").alias("n"))


def styled_text(runs: DataFrame, char_shapes: DataFrame, r: Renderer) -> DataFrame:
    """file, path, ord, kind, control, text of each run in its character style; marks have no text."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    struck = (F.col("strike") > 0) | (F.col("underline") == 2)
    shapes = char_shapes.select("file", F.col("id").alias("char_shape"), F.col("id").alias("shape"), "bold", "italic", "superscript", "subscript", struck.alias("struck"), F.col("underline").isin(1, 3).alias("under"))
    found = runs.join(shapes, ["file", "char_shape"], "left")
    styled = r.text(F.col("text"), on("bold"), on("italic"), on("under"), on("struck"), on("superscript"), on("subscript"), F.col("shape"))
    return found.select("file", "path", "ord", "kind", "control", F.when(F.col("kind") == "text", styled).alias("text"))


def pictures(controls: DataFrame, bin_items: DataFrame, binaries: DataFrame | None, r: Renderer) -> DataFrame:
    """file, control, shown: pictures as files of a folder (ID.extension), or their data where these are given; a picture without a part shows its id."""
    held = controls.where("kind = 'gso ' and target is not null").select("file", F.col("path").alias("control"), F.col("target").alias("id"))
    items = bin_items.groupBy("file", "id").agg(F.min("format").alias("format"))
    found, folder = held.join(items, ["file", "id"], "left"), r.options.folder()
    name = F.concat("id", F.lit("."), F.col("format"))
    url = F.when(F.col("format").isNull(), F.col("id")).otherwise(F.concat(F.lit(f"{folder.rstrip('/')}/" if folder else ""), name))
    if binaries is not None:
        found = found.join(binaries.groupBy("file", "id").agg(F.min("data").alias("data")), ["file", "id"], "left")
        url = F.when(F.col("data").isNull(), url).otherwise(X.image_url(F.col("data"), X.media_type(F.col("format")), name, None))
    return found.select("file", "control", r.image(url).alias("shown"))


def linked(pieces: DataFrame, r: Renderer) -> DataFrame:
    """file, path, ord, text: text between a link's begin and end, across runs, as one link; a link that isn't closed ends with its paragraph.

    pieces: file, path, ord, mark (begin, end or null), url, text. A link that begins inside a word is plain text; one without text shows its address."""
    upto = Window.partitionBy("file", "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = pieces.withColumn("link", F.sum(F.when(F.col("mark") == "begin", 1).otherwise(0)).over(upto)).withColumn("state", F.last("mark", ignorenulls=True).over(upto))
    inside = (F.col("state") == "begin") & F.col("link").isNotNull()
    first = F.max(F.when(F.col("mark") == "begin", F.col("ord"))).over(upto)
    grouped = marked.withColumn("piece", F.when(inside, first).otherwise(F.col("ord"))).withColumn("inside", inside)
    merged = grouped.groupBy("file", "path", "piece").agg(ordered(["ord"], "text", "").alias("text"), F.max("url").alias("url"), F.bool_or("inside").alias("inside"))
    before = F.lag("text").over(Window.partitionBy("file", "path").orderBy("piece"))
    link = r.link(before, F.col("text"), F.col("url"))
    text = F.when(F.col("inside") & F.col("url").isNotNull() & (F.col("url") != ""), link).otherwise(F.col("text"))
    return merged.select("file", "path", F.col("piece").alias("ord"), text.alias("text"))


def paragraph_texts(tables: dict[str, DataFrame], r: Renderer) -> DataFrame:
    """file, path, text of each paragraph with text, links, pictures, equations, note references and automatic numbers in place.

    tables: runs, char_shapes, controls; bin_items (and binaries to embed) for pictures; settings and note_shapes for numbers, where given."""
    controls = tables["controls"]
    runs = styled_text(tables["runs"], tables["char_shapes"], r)
    link = F.when(F.col("kind") == "%hlk", F.coalesce(X.command_to_url(F.col("target")), "target"))
    equation = F.when(F.col("kind") == "eqed", r.equation(F.col("target")))
    shown = controls.where("kind in ('%hlk', 'eqed')").select("file", F.col("path").alias("control"), equation.alias("shown"), link.alias("url"))
    more = [automatic_numbers(controls, tables.get("settings"), tables.get("note_shapes")).select("file", F.col("path").alias("control"), r.escape(F.col("shown")).alias("shown"))]
    label = F.when(F.col("kind") == "fn  ", r.footnote_ref(F.col("n"))).otherwise(r.endnote_ref(F.col("n")))
    more.append(note_numbers(controls).select("file", F.col("path").alias("control"), label.alias("shown")))
    if "bin_items" in tables:
        more.append(pictures(controls, tables["bin_items"], tables.get("binaries") if r.options.embed_images else None, r))
    for one in more:
        shown = shown.unionByName(one.withColumn("url", F.lit(None).cast("string")))
    pieces = runs.join(shown, ["file", "control"], "left")
    mark = F.when(F.col("kind").isin(*FIELD_ENDS), F.lit("end")).when(F.col("url").isNotNull(), F.lit("begin"))
    pieces = pieces.select("file", "path", "ord", mark.alias("mark"), "url", F.coalesce(F.when(F.col("kind") == "text", F.col("text")), "shown", F.lit("")).alias("text"))
    return linked(pieces, r).groupBy("file", "path").agg(ordered(["ord"], "text", "").alias("text"))
