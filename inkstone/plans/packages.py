"""Elements of the package format: rows are written as XML, packed into packages, and read back as typed fields. Each query's SQL twin reads the same values from the rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions.text import html_escape
from inkstone.plans.relations import read, spread
from inkstone.sources import documents
from inkstone.sources.writer import to_files

# Fields of an element for each row of part: kind, attribute or child.attribute, SQL expression; where the reader is to understand it otherwise, -> what it reads.
PLACE = (
    "int id = p_partkey; int zOrder = p_size - 25; name numberingType = CASE WHEN p_size % 2 = 0 THEN 'TABLE' ELSE 'no such' END -> CASE WHEN p_size % 2 = 0 THEN 'TABLE' ELSE 'NONE' END; name textWrap = 'SQUARE'; flag lock = p_size % 2; "
    "int sz.width = p_partkey * 10; name sz.widthRelTo = 'PARA'; int sz.height = p_size; flag pos.treatAsChar = 1; name pos.vertRelTo = 'nonsense' -> 'PAPER'; name pos.horzAlign = 'RIGHT'; int pos.vertOffset = 0 - p_partkey; int outMargin.left = p_size; int outMargin.top = 0"
)
PEN = "colour lineShape.color = p_partkey; int lineShape.width = p_size; name lineShape.style = 'DASH_DOT'; name lineShape.headStyle = 'SPEAR'; flag lineShape.headfill = 1; name lineShape.tailSz = 'wrong' -> 'MEDIUM_MEDIUM'"
XY = "; ".join(f"int pt{k}.x = p_partkey + {k}; int pt{k}.y = {k} - p_size" for k in range(4))
SHAPE = f"{PLACE}; {PEN}; int orgSz.width = 5; flag flip.horizontal = p_size % 2; num rotationInfo.angle = p_size"
NOTE = "name autoNumFormat.type = 'ROMAN_SMALL'; text autoNumFormat.suffixChar = ')'; flag autoNumFormat.supscript = 1; name numbering.type = 'ON_SECTION'; int numbering.newNum = p_size; name placement.place = 'elsewhere' -> '{place}'; int noteLine.length = p_partkey; name noteLine.type = 'WAVE'; int noteSpacing.aboveLine = 850"
SEVEN = "; ".join(f"int fontRef.{g} = p_size + {k}; int ratio.{g} = 90 + {k}" for k, g in enumerate(("hangul", "latin", "hanja", "japanese", "other", "symbol", "user")))
SECTION = {
    "secPr": "name textDirection = 'VERTICAL'; int spaceColumns = p_size; int tabStop = p_partkey; int outlineShapeIDRef = 1; int grid.lineGrid = p_size; name startNum.pageStartsOn = 'EVENPAGE' -> 'EVEN'; int startNum.page = p_size; flag visibility.hideFirstHeader = 1; name visibility.border = 'HIDE_FIRST'; name lineNumberShape.restartType = '1' -> 'RESTART_BY_PAGE'; int lineNumberShape.countBy = p_size",
    "pagePr": "name landscape = 'NARROWLY' -> 'WIDELY'; int width = 59528 + p_size; int height = 84188; name gutterType = 'LEFT_RIGHT'; int margin.left = p_partkey; int margin.header = 4252; int margin.gutter = p_size", "footNotePr": NOTE.replace("{place}", "EACH_COLUMN"), "endNotePr": NOTE.replace("{place}", "END_OF_DOCUMENT"),
    "pageBorderFill": "text type = 'BOTH'; int borderFillIDRef = p_size; name textBorder = 'TEXT'; flag headerInside = 1; name fillArea = 'PAPERLINE'; int offset.left = 1417; int offset.bottom = p_partkey", "colPr": "int id = p_partkey; name type = 'BALANCED' -> 'BALANCED_NEWSPAPER'; int colCount = p_size; name layout = 'MIRROR'; flag sameSz = p_size % 2; int sameGap = p_partkey",
    "header": "int id = p_partkey; name applyPageType = 'ODD'", "footer": "int id = p_partkey; name applyPageType = 'x' -> 'BOTH'", "footNote": "int number = p_size; int instId = p_partkey", "endNote": "int number = p_size; int instId = p_partkey",
    "autoNum": "int num = p_partkey; name numType = 'TABLE'; name autoNumFormat.type = 'CIRCLED_DIGIT'; text autoNumFormat.prefixChar = '('", "newNum": "int num = p_partkey; name numType = 'odd' -> 'PICTURE'", "bookmark": "text name = p_name", "compose": "text circleType = 'SHAPE_CIRCLE'; int charSz = p_size; text composeText = p_brand",
    "fieldBegin": "int id = p_partkey; name type = CASE WHEN p_size % 2 = 0 THEN 'HYPERLINK' ELSE 'SUMMARY' END; text name = p_name; flag editable = 1; int fieldid = p_size", "fieldEnd": "int beginIDRef = p_partkey; int fieldid = p_size", "dutmal": "name posType = 'BOTTOM'; int szRatio = p_size; int option = p_partkey; name align = 'CENTER'; body mainText = p_name; body subText = p_brand",
    "subList": "int id = p_partkey; name textDirection = 'VERTICALALL'; name vertAlign = 'BASELINE'; int textWidth = p_size; flag hasNumRef = 1", "tbl": PLACE + "; name pageBreak = 'CELL'; flag repeatHeader = 1; int rowCnt = p_size; int colCnt = 3; int borderFillIDRef = p_partkey; int inMargin.left = 510",
    "tc": "text name = p_name; flag header = 1; int borderFillIDRef = p_size; int cellAddr.colAddr = p_partkey % 7; int cellAddr.rowAddr = p_size; int cellSpan.colSpan = 2; int cellSz.width = p_partkey; int cellMargin.left = 141", "pic": PLACE + "; flag reverse = 1; text img.binaryItemIDRef = 'image1'; int img.bright = 0 - p_size; name img.effect = 'GRAY_SCALE'; int imgDim.dimwidth = p_partkey; int imgClip.right = p_size; int inMargin.top = 3",
    "imgRect": XY, "line": SHAPE + "; flag isReverseHV = 1; int startPt.x = 0 - p_partkey; int startPt.y = 1; int endPt.x = p_size; int endPt.y = 2", "rect": SHAPE + "; int ratio = p_size; " + XY, "ellipse": SHAPE + "; flag intervalDirty = 1", "arc": SHAPE + "; name type = 'CHORD'", "polygon": SHAPE, "curve": SHAPE, "container": PLACE + "; int groupLevel = p_size; int offset.x = p_partkey",
    "equation": PLACE + "; text version = 'v1'; colour textColor = p_partkey; int baseUnit = 1000; body script = p_name", "ole": SHAPE + "; name objectType = 'LINK'; text binaryItemIDRef = 'ole1'; flag hasMoniker = 1; name drawAspect = 'ICON'; int extent.x = p_partkey; int extent.y = p_size", "connectLine": SHAPE + "; name type = 'ARC_BOTH'; int startPt.x = p_partkey; int startPt.subjectIDRef = p_size; int endPt.y = 4; int endPt.subjectIdx = 2",
    "point": "int x = p_partkey; int y = 0 - p_size; int type = 3", "textart": SHAPE + "; text text = p_name; text textartPr.fontName = p_brand; int textartPr.lineSpacing = p_size; name textartPr.align = 'CENTER'; " + XY, "video": PLACE + "; name videotype = 'Web'; text fileIDRef = p_brand; text tag = p_name", "caption": "name side = 'TOP'; flag fullSz = 1; int width = p_partkey; int gap = 850; int lastWidth = p_size",
    "effects": "name shadow.style = 'INSIDE'; num shadow.alpha = p_size; int shadow.radius = p_partkey; int glow.radius = p_size; int softEdge.radius = 2; num reflection.direction = 90; int reflection.distance = p_partkey", "lineseg": "int textpos = p_size; int vertpos = p_partkey; int vertsize = 1000; int textheight = 1000; int baseline = 850; int spacing = 600; int horzpos = 0 - 5; int horzsize = 42520; int flags = 393216",
}
HEAD = {
    "beginNum": "int page = p_size; int footnote = 2; int tbl = p_partkey; int equation = 1", "font": "int id = p_partkey; text face = p_name; name type = 'HFT'; flag isEmbedded = 1; text substFont.face = p_brand; text typeInfo.familyType = 'FCAT_GOTHIC'",
    "charPr": "int id = p_partkey; int height = 1000 + p_size; colour textColor = p_partkey * 3; flag useKerning = 1; name symMark = 'TILDE'; int borderFillIDRef = p_size; " + SEVEN + "; name underline.type = 'CENTER'; name underline.shape = 'DOUBLEWAVE'; colour underline.color = p_size; name outline.type = 'THICK'; name shadow.type = 'DROP'",
    "borderFill": "int id = p_partkey; flag threeD = 1; name centerLine = 'BOTH'; name slash.type = 'ALL'; flag slash.isCounter = 1; " + "; ".join(f"name {side}.type = 'DOUBLE_SLIM'; text {side}.width = '0.4 mm'; colour {side}.color = p_partkey" for side in ("leftBorder", "rightBorder", "topBorder", "bottomBorder", "diagonal")),
    "winBrush": "colour faceColor = p_partkey; colour hatchColor = p_size; name hatchStyle = 'CROSS'; int alpha = 5", "gradation": "name type = 'CONICAL'; int angle = p_size; int centerX = 50; int step = p_size; int colorNum = 2", "imgBrush": "name mode = 'TILE_HORZ_TOP'; text img.binaryItemIDRef = p_brand; int img.contrast = 0 - p_size; name img.effect = 'BLACK_WHITE'",
    "tabPr": "int id = p_partkey; flag autoTabLeft = 1; flag autoTabRight = p_size % 2", "numbering": "int id = p_partkey; int start = p_size", "bullet": "int id = p_partkey; text char = '*'; flag useImg = 1; text img.binaryItemIDRef = p_brand",
    "paraPr": "int id = p_partkey; int tabPrIDRef = p_size; int condense = 20; flag snapToGrid = 1; name align.horizontal = 'DISTRIBUTE_SPACE'; name align.vertical = 'CENTER'; name heading.type = 'BULLET'; int heading.idRef = p_size; int heading.level = 2; name breakSetting.breakLatinWord = 'HYPHENATION'; flag breakSetting.widowOrphan = 1; flag autoSpacing.eAsianEng = 1; name lineSpacing.type = 'BETWEEN' -> 'BETWEEN'; int lineSpacing.value = 130 + p_size; int border.borderFillIDRef = p_size; int border.offsetTop = 7",
    "margin": "int intent.value = 0 - p_partkey; name intent.unit = 'CHAR'; int left.value = p_size; int right.value = 2; int prev.value = 3; int next.value = 4", "style": "int id = p_partkey; name type = 'CHAR'; text name = p_name; text engName = p_type; int paraPrIDRef = p_size; int charPrIDRef = 2; int nextStyleIDRef = 3; int langID = 1042; flag lockForm = 1",
}


def split_spec(spec: str) -> list[tuple[str, str, str, str]]:
    """(kind, path, given, read) of each field."""
    out = []
    for line in spec.split(";"):
        kind, path, rest = re.match(r"\s*(\w+)\s+([\w.]+)\s*=\s*(.*)", line, re.S).groups()
        given, _, found = rest.partition(" -> ")
        out.append((kind, path, given.strip(), (found or given).strip()))
    return out


def element_query(name: str, spec: str, part: str):
    fields = split_spec(spec)
    alias = lambda path: path.replace(".", "_")

    def written(kind: str, given: str):
        value = F.expr(given)
        if kind == "colour":
            return F.concat(F.lit("#"), F.lpad(F.hex(value.cast("long")), 6, "0"))
        return html_escape(value.cast("string"))

    def run(spark: SparkSession, d: str) -> DataFrame:
        pieces, bodies, children = [F.lit(f'<x:{name} xmlns:x="urn:x"')], [], {}
        for kind, path, given, _ in fields:
            child, _, attribute = path.rpartition(".")
            if kind == "body":
                bodies.append(F.concat(F.lit(f"<x:{path}>"), written(kind, given), F.lit(f"</x:{path}>")))
            elif child:
                children.setdefault(child, []).append((attribute, written(kind, given)))
            else:
                pieces += [F.lit(f' {attribute}="'), written(kind, given), F.lit('"')]
        pieces.append(F.lit(">"))
        for child, attributes in children.items():
            pieces += [F.lit(f"<x:{child}"), *(x for a, v in attributes for x in (F.lit(f' {a}="'), v, F.lit('"'))), F.lit("/>")]
        xml = F.concat(*pieces, *bodies, F.lit(f"</x:{name}>"))
        held = read(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", xml.alias("xml")))).alias("xs"))
        whole = F.concat(F.lit("<root>"), F.array_join(F.transform("xs", lambda x: x["xml"]), ""), F.lit("</root>")).cast("binary")
        files = to_files(spread(held, "file"), F.col("file"), F.create_map(F.lit("Contents/header.xml" if part == "head" else "Contents/section0.xml"), whole), "package")
        found = documents.read_table(files, "elements").where(F.col("name") == name)
        value = lambda path: F.get_json_object("fields", f"$['{path}']")
        body = {path: f"{path}." for kind, path, _, _ in fields if kind == "body"}
        kinds = {"int": "long", "colour": "long", "num": "double", "flag": "boolean"}
        cols = [value(body.get(path, path)).cast(kinds.get(kind, "string")).alias(alias(path)) for kind, path, _, _ in fields]
        place = F.row_number().over(Window.partitionBy("file").orderBy("seq")).cast("long")
        return found.select("file", place.alias("place"), *cols)

    casts = {"int": "CAST({} AS BIGINT)", "colour": "CAST({} AS BIGINT)", "num": "CAST({} AS DOUBLE)", "flag": "({} = 1)"}
    cols = ", ".join(f"{casts.get(kind, '{}').format(found)} AS {alias(path)}" for kind, path, _, found in fields)
    return run, f"SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place, {cols} FROM part"


def catalog() -> dict:
    return {f"element_{name}": element_query(name, spec, part) for part, specs in (("section", SECTION), ("head", HEAD)) for name, spec in specs.items()}
