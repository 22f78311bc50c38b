"""Renderers: how the parts of a document are written, as column expressions. Two are built in; register adds others under a name of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.functions.values import mm_text, unit_to_mm
from inkstone.operators import tables as T


def lit(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@dataclass(frozen=True)
class Options:
    """What both renderings may be asked for.

    image_folder: pictures are named as files of this folder; embed_images: as data in place; html_folder: the folder of the page, which picture paths are then relative to;
    use_html: line breaks of Markdown as <br>; include_version and include_page_info: lines at the document's top; css_prefix: before every class; layout: placed lines."""

    image_folder: str | None = None
    embed_images: bool = False
    html_folder: str | None = None
    use_html: bool = False
    include_version: bool = False
    include_page_info: bool = False
    css_prefix: str = ""
    layout: bool = False

    def folder(self) -> str | None:
        """Where a page finds its pictures."""
        import posixpath

        return posixpath.relpath(self.image_folder, self.html_folder) if self.image_folder and self.html_folder else self.image_folder


class Renderer:
    """The plain text of a document; renderings override what they write otherwise."""

    name, line, block = "text", "\n", "\n\n"

    def __init__(self, options: Options | None = None):
        self.options = options or Options()

    def escape(self, t: Column) -> Column:
        return t

    def bold(self, t: Column) -> Column:
        return t

    def italic(self, t: Column) -> Column:
        return t

    def underline(self, t: Column) -> Column:
        return t

    def strikethrough(self, t: Column) -> Column:
        return t

    def superscript(self, t: Column) -> Column:
        return t

    def subscript(self, t: Column) -> Column:
        return t

    def classed(self, t: Column, shape: Column) -> Column:
        return t

    def text(self, t: Column, bold: Column, italic: Column, under: Column, struck: Column, sup: Column, sub: Column, shape: Column) -> Column:
        """A run's text in its style: italic inside bold inside strike; white space alone stays bare."""
        out = self.escape(t)
        for on, style in ((italic, self.italic), (bold, self.bold), (struck, self.strikethrough), (under, self.underline), (sup, self.superscript), (sub, self.subscript)):
            out = F.when(on, style(out)).otherwise(out)
        return F.when(F.trim(t) == "", self.escape(t)).otherwise(self.classed(out, shape))

    def link(self, before: Column, t: Column, url: Column) -> Column:
        return F.when(t == "", url).otherwise(t)

    def image(self, url: Column) -> Column:
        return F.lit("")

    def equation(self, script: Column) -> Column:
        return script

    def footnote_ref(self, n: Column) -> Column:
        return lit("(", n.cast("string"), ")")

    def endnote_ref(self, n: Column) -> Column:
        return lit("(e", n.cast("string"), ")")

    def footnote_back(self, n: Column, t: Column) -> Column:
        return lit(n.cast("string"), ") ", t)

    def endnote_back(self, n: Column, t: Column) -> Column:
        return lit("e", n.cast("string"), ") ", t)

    def outline_number(self, level: Column, mark: Column, t: Column) -> Column:
        return lit(mark, " ", self.breaks(t))

    def list_item(self, level: Column, mark: Column, t: Column) -> Column:
        return lit(F.repeat(F.lit("  "), level.cast("int") - 1), mark, " ", self.breaks(t))

    def bullet(self, mark: Column, t: Column) -> Column:
        return lit("- ", self.breaks(t))

    def paragraph(self, t: Column, shape: Column) -> Column:
        return self.breaks(t)

    def caption(self, t: Column) -> Column:
        return t

    def breaks(self, t: Column) -> Column:
        return t

    def table(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        """keys, text of each table. cells: row, col, row_span, col_span, text, style."""
        return T.markdown_table(cells, keys).withColumnRenamed("markdown", "text")

    def cell(self, t: Column) -> Column:
        return X.plain_cell(t)

    cell_line = "<br> "

    def page_break(self) -> str:
        return "---"

    def document_header(self, version: Column, width: Column, height: Column) -> Column:
        """Lines at the top: the version, the first page's size."""
        rows = []
        if self.options.include_version:
            rows.append(lit("**버전**: ", version))
        if self.options.include_page_info:
            rows.append(lit("**용지 크기**: ", mm_text(unit_to_mm(width)), " x ", mm_text(unit_to_mm(height))))
        return F.concat_ws("\n\n", *rows)

    def document_footer(self, t: Column) -> Column:
        return t

    def document(self, t: Column) -> Column:
        return t


class Markdown(Renderer):
    name = "markdown"

    def bold(self, t: Column) -> Column:
        return lit("**", t, "**")

    def italic(self, t: Column) -> Column:
        return lit("*", t, "*")

    def strikethrough(self, t: Column) -> Column:
        return lit("~~", t, "~~")

    def link(self, before: Column, t: Column, url: Column) -> Column:
        return X.link_markdown(before, t, url)

    def image(self, url: Column) -> Column:
        return lit("![이미지](", url, ")")

    def equation(self, script: Column) -> Column:
        return lit("$", script, "$")

    def footnote_ref(self, n: Column) -> Column:
        return lit("[^", n.cast("string"), "]")

    def endnote_ref(self, n: Column) -> Column:
        return lit("[^e", n.cast("string"), "]")

    def footnote_back(self, n: Column, t: Column) -> Column:
        return lit("[^", n.cast("string"), "]: ", t)

    def endnote_back(self, n: Column, t: Column) -> Column:
        return lit("[^e", n.cast("string"), "]: ", t)

    def outline_number(self, level: Column, mark: Column, t: Column) -> Column:
        return lit(F.repeat(F.lit("#"), level.cast("int")), " ", mark, " ", self.breaks(t))

    def breaks(self, t: Column) -> Column:
        return F.replace(t, F.lit("\n"), F.lit("<br>" if self.options.use_html else "  \n"))


class Html(Renderer):
    name, block, cell_line = "html", "\n", ""

    def tag(self, name: str, t: Column, attributes: str = "") -> Column:
        return lit(f"<{name}{attributes}>", t, f"</{name}>")

    def escape(self, t: Column) -> Column:
        return X.html_escape(t)

    def bold(self, t: Column) -> Column:
        return self.tag("strong", t)

    def italic(self, t: Column) -> Column:
        return self.tag("em", t)

    def underline(self, t: Column) -> Column:
        return self.tag("u", t)

    def strikethrough(self, t: Column) -> Column:
        return self.tag("del", t)

    def superscript(self, t: Column) -> Column:
        return self.tag("sup", t)

    def subscript(self, t: Column) -> Column:
        return self.tag("sub", t)

    def classed(self, t: Column, shape: Column) -> Column:
        return F.when(shape.isNull(), t).otherwise(lit(f'<span class="{self.options.css_prefix}cs-', shape.cast("string"), '">', t, "</span>"))

    def link(self, before: Column, t: Column, url: Column) -> Column:
        return lit('<a href="', X.attribute_escape(url), '">', F.when(t == "", X.html_escape(url)).otherwise(t), "</a>")

    def image(self, url: Column) -> Column:
        return lit('<img src="', X.attribute_escape(url), '" alt="이미지">')

    def equation(self, script: Column) -> Column:
        return lit(f'<span class="{self.options.css_prefix}equation">', X.html_escape(script), "</span>")

    def note(self, kind: str, n: Column) -> Column:
        d = n.cast("string")
        return lit(f'<sup id="{kind}ref-', d, f'"><a href="#{kind}-', d, '">', d, "</a></sup>")

    def footnote_ref(self, n: Column) -> Column:
        return self.note("fn", n)

    def endnote_ref(self, n: Column) -> Column:
        return self.note("en", n)

    def back(self, kind: str, n: Column, t: Column) -> Column:
        d = n.cast("string")
        return lit(f'<div class="{self.options.css_prefix}note" id="{kind}-', d, f'"><a href="#{kind}ref-', d, '">', d, ")</a> ", t, "</div>")

    def footnote_back(self, n: Column, t: Column) -> Column:
        return self.back("fn", n, t)

    def endnote_back(self, n: Column, t: Column) -> Column:
        return self.back("en", n, t)

    def outline_number(self, level: Column, mark: Column, t: Column) -> Column:
        p = self.options.css_prefix
        tag = F.when(level <= 6, F.concat(F.lit("h"), level.cast("int").cast("string"))).otherwise(F.lit("p"))
        return lit("<", tag, f' class="{p}outline-', level.cast("int").cast("string"), f'"><span class="{p}outline-number">', X.html_escape(mark), "</span> ", self.breaks(t), "</", tag, ">")

    def list_item(self, level: Column, mark: Column, t: Column) -> Column:
        return lit("<p>", X.html_escape(mark), " ", self.breaks(t), "</p>")

    def bullet(self, mark: Column, t: Column) -> Column:
        return lit("<p>", X.bullet_mark(mark), " ", self.breaks(t), "</p>")

    def paragraph(self, t: Column, shape: Column) -> Column:
        return lit(f'<p class="{self.options.css_prefix}ps-', F.coalesce(shape.cast("string"), F.lit("0")), '">', self.breaks(t), "</p>")

    def caption(self, t: Column) -> Column:
        return lit(f'<div class="{self.options.css_prefix}caption">', t, "</div>")

    def table(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        return T.html_table(cells, keys, escape=False, css=f"{self.options.css_prefix}table").withColumnRenamed("html", "text")

    def cell(self, t: Column) -> Column:
        return t

    def page_break(self) -> str:
        return "<hr>"

    def document_header(self, version: Column, width: Column, height: Column) -> Column:
        rows = []
        if self.options.include_version:
            rows.append(lit("<p>버전: ", version, "</p>"))
        if self.options.include_page_info:
            rows.append(lit("<p>용지 크기: ", mm_text(unit_to_mm(width)), " x ", mm_text(unit_to_mm(height)), "</p>"))
        return F.concat_ws("\n", *rows)

    def document(self, t: Column) -> Column:
        return lit("<article>\n", t, "\n</article>")

    def breaks(self, t: Column) -> Column:
        return F.replace(t, F.lit("\n"), F.lit("<br>"))


REGISTRY: dict[str, type[Renderer]] = {"text": Renderer, "markdown": Markdown, "html": Html}


def register(name: str, renderer: type[Renderer]) -> None:
    REGISTRY[name] = renderer


def renderer(name: str, options: Options | None = None) -> Renderer:
    return REGISTRY[name](options)
