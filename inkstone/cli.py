"""Command line: python -m inkstone.cli to-json|to-markdown|to-html|to-css|file-header|info|extract-images|batch FOLDER [-o OUT] [--format F] [options].

Results are written as one table or folder each, keyed by the whole path of a file, so files of one name don't overwrite each other."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from inkstone.operators import layout, render, views
from inkstone.operators.renderers import Options
from inkstone.sources import documents

def tables(files: DataFrame, names: tuple[str, ...], folder: str | None = None) -> dict[str, DataFrame]:
    """Several tables, each file decoded once."""
    return documents.read_tables(files, names, folder)


def result(spark: SparkSession, command: str, folder: str, kind: str | None = None, options: Options | None = None, pretty: bool = False, out: str | None = None) -> DataFrame:
    files = documents.scan(spark, folder)
    options = options or Options()
    if command in ("to-markdown", "to-html"):
        if options.layout:
            return layout.layout_html(tables(files, ("paragraphs", "runs", "line_segments", "pages")))
        return render.document_text(tables(files, (*render.TEXT_TABLES, *render.MORE_TABLES, *(("binaries",) if options.embed_images else ()))), command == "to-html", options)
    if command == "to-json":
        return render.document_json(tables(files, ("headers", "meta", "runs", "paragraphs", "controls", "char_shapes", "para_shapes", "styles", "numberings", "bullets", "border_fills", "cells", "pages")), pretty)
    if command == "file-header":
        return render.header_json(documents.read_table(files, "headers"))
    if command == "to-css":
        return render.document_css(tables(files, ("char_shapes", "para_shapes", "fonts")), options.css_prefix)
    if command == "info":
        return views.info(tables(files, ("headers", "paragraphs", "binaries")))
    if command == "extract-images":
        found = documents.read_table(files, "binaries")
        return render.write_files(render.image_files(found, kind), out) if out else render.images(found, kind)
    if command == "batch":
        return documents.batch_status(files)
    raise ValueError(f"unknown command {command}")


COMMANDS = ("to-json", "to-markdown", "to-html", "to-css", "file-header", "info", "extract-images", "batch")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="inkstone")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("folder")
    p.add_argument("-o", "--out", help="folder for the result as Parquet (of extract-images: for the pictures); shown on the screen otherwise")
    p.add_argument("--format", help="only images of this format")
    p.add_argument("--pretty", action="store_true", help="JSON over several lines")
    p.add_argument("--images", help="folder that pictures are named in")
    p.add_argument("--embed", action="store_true", help="pictures as data in place")
    p.add_argument("--use-html", action="store_true", help="line breaks of Markdown as <br>")
    p.add_argument("--version-line", action="store_true")
    p.add_argument("--page-line", action="store_true")
    p.add_argument("--prefix", default="", help="before every class of HTML")
    p.add_argument("--layout", action="store_true", help="HTML with placed lines, a page a row")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("inkstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options = Options(a.images, a.embed, None, a.use_html, a.version_line, a.page_line, a.prefix, a.layout)
    pictures = a.command == "extract-images"
    found = result(spark, a.command, a.folder, a.format, options, a.pretty, a.out if pictures else None)
    if a.out and not pictures:
        found.write.mode("overwrite").parquet(a.out)
    else:
        found.show(truncate=200)


if __name__ == "__main__":
    main()
