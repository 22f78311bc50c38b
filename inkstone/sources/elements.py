"""Typed fields of the package format's XML elements, as data, and one reader for them.

A layout is a text of fields `kind path=default`, comma-separated. A path is an attribute, `child.attribute` of a child element (absent without that child), or
`child.` for a child's text; `{child: fields}` lists all children of a name. Kinds: int, num, bool, str, colour (a number), or a list of ENUMS, whose first name stands
for whatever is unknown.
"""

from __future__ import annotations

import re
from functools import lru_cache
from xml.etree import ElementTree

# Names in attributes, the default first; `A|B` are two spellings of the last one.
LINES = "SOLID DOT DASH DASH_DOT DASH_DOT_DOT LONG_DASH CIRCLE DOUBLE_SLIM SLIM_THICK THICK_SLIM SLIM_THICK_SLIM"
NUMBERS = "DIGIT CIRCLED_DIGIT ROMAN_CAPITAL ROMAN_SMALL LATIN_CAPITAL LATIN_SMALL CIRCLED_LATIN_CAPITAL CIRCLED_LATIN_SMALL HANGUL_SYLLABLE CIRCLED_HANGUL_SYLLABLE HANGUL_JAMO CIRCLED_HANGUL_JAMO HANGUL_PHONETIC IDEOGRAPH CIRCLED_IDEOGRAPH DECAGON_CIRCLE DECAGON_CIRCLE_HANJA SYMBOL USER_CHAR"
ENUMS = {
    "direction": "HORIZONTAL VERTICAL VERTICALALL", "landscape": "PORTRAIT LANDSCAPE NARROWLY|WIDELY", "gutter": "LEFT_ONLY LEFT_RIGHT TOP_BOTTOM", "starts_on": "BOTH EVENPAGE|EVEN ODDPAGE|ODD",
    "visibility": "SHOW_ALL HIDE_FIRST SHOW_FIRST", "line_restart": "RESTART_BY_SECTION 1|RESTART_BY_PAGE 2|KEEP_CONTINUE", "number": NUMBERS, "note_restart": "CONTINUOUS ON_SECTION ON_PAGE",
    "note_place": "EACH_COLUMN MERGED_COLUMN RIGHT_MOST_COLUMN", "end_restart": "CONTINUOUS ON_SECTION", "end_place": "END_OF_DOCUMENT END_OF_SECTION", "line": "NONE " + LINES, "wavy_line": "NONE " + LINES + " WAVE DOUBLEWAVE",
    "pen_line": "NONE SOLID DOT THICK DASH DASH_DOT DASH_DOT_DOT", "page_border": "PAPER TEXT", "fill_area": "PAPER TEXT PAPERLINE", "columns": "NEWSPAPER BALANCED|BALANCED_NEWSPAPER PARALLEL", "column_layout": "LEFT RIGHT MIRROR",
    "apply": "BOTH EVEN ODD FIRST", "auto_number": "PICTURE PAGE FOOTNOTE ENDNOTE TABLE EQUATION TOTAL_PAGE", "numbering": "NONE PICTURE TABLE EQUATION",
    "wrap": "IN_FRONT_OF_TEXT SQUARE TIGHT THROUGH TOP_AND_BOTTOM BEHIND_TEXT", "flow": "BOTH_SIDES LEFT_ONLY RIGHT_ONLY LARGEST_ONLY", "relative": "PAPER PAGE COLUMN PARA", "size": "ABSOLUTE PAPER PAGE COLUMN PARA PERCENT",
    "vertical": "TOP CENTER BOTTOM BASELINE INSIDE OUTSIDE", "horizontal": "LEFT CENTER RIGHT INSIDE OUTSIDE", "table_break": "NONE TABLE CELL", "drop_cap": "None DoubleLine TripleLine Margin", "effect": "REAL_PIC GRAY_SCALE BLACK_WHITE",
    "tab": "LEFT RIGHT CENTER DECIMAL", "end_cap": "FLAT ROUND", "arrow": "NORMAL ARROW SPEAR CONCAVE_ARROW EMPTY_DIAMOND EMPTY_CIRCLE EMPTY_BOX FILLED_DIAMOND FILLED_CIRCLE FILLED_BOX",
    "arrow_size": "MEDIUM_MEDIUM SMALL_SMALL SMALL_MEDIUM SMALL_LARGE MEDIUM_SMALL MEDIUM_LARGE LARGE_SMALL LARGE_MEDIUM LARGE_LARGE", "outline_style": "NORMAL OUTER INNER",
    "shape_shadow": "NONE PARELLEL_LEFTTOP PARELLEL_RIGHTTOP PARELLEL_LEFTBOTTOM PARELLEL_RIGHTBOTTOM", "arc": "NORMAL PIE CHORD", "segment": "CURVE LINE", "side": "BOTTOM LEFT RIGHT TOP", "ole": "UNKNOWN EMBEDDED LINK STATIC EQUATION",
    "aspect": "CONTENT THUMB_NAIL ICON DOC_PRINT", "connector": "STRAIGHT_NOARROW STRAIGHT_ONEWAY STRAIGHT_BOTH STROKE_NOARROW STROKE_ONEWAY STROKE_BOTH ARC_NOARROW ARC_ONEWAY ARC_BOTH", "video": "Local Web",
    "ruby_place": "TOP BOTTOM CENTER", "shadow_style": "OUTSIDE INSIDE",
    "field": "CLICK_HERE HYPERLINK BOOKMARK FORMULA SUMMERY|SUMMARY USER_INFO DATE DOC_DATE PATH CROSSREF MAILMERGE MEMO PROOFREADING_MARKS PRIVATE_INFO METATAG OUTLINE",
    "heading": "NONE OUTLINE NUMBER BULLET", "align": "JUSTIFY LEFT RIGHT CENTER DISTRIBUTE DISTRIBUTE_SPACE", "para_vertical": "BASELINE TOP CENTER BOTTOM", "latin_break": "KEEP_WORD HYPHENATION BREAK_WORD", "other_break": "KEEP_WORD BREAK_WORD",
    "line_wrap": "BREAK SQUEEZE KEEP", "spacing": "PERCENT FIXED AT_LEAST BETWEEN_LINES|BETWEEN", "unit": "HWPUNIT CHAR", "style": "PARA CHAR", "underline": "NONE BOTTOM CENTER TOP", "char_outline": "NONE SOLID DOT THICK DASH DASH_DOT DASH_DOT_DOT",
    "char_shadow": "NONE DROP CONTINUOUS", "centre_line": "NONE LEFT RIGHT BOTH", "slash": "NONE CENTER CENTER_BELOW CENTER_ABOVE ALL", "hatch": "HORIZONTAL VERTICAL BACK_SLASH SLASH CROSS CROSS_DIAGONAL", "gradation": "LINEAR RADIAL CONICAL SQUARE",
    "image_mode": "TOTAL TILE TILE_HORZ_TOP TILE_HORZ_BOTTOM TILE_VERT_LEFT TILE_VERT_RIGHT CENTER CENTER_TOP CENTER_BOTTOM LEFT_CENTER LEFT_TOP LEFT_BOTTOM RIGHT_CENTER RIGHT_TOP RIGHT_BOTTOM ZOOM",
    "font": "REP TTF TTC HFT", "mark": "NONE DOT_ABOVE RING_ABOVE TILDE CARON SIDE COLON GRAVE_ACCENT ACUTE_ACCENT CIRCUMFLEX MACRON HOOK_ABOVE DOT_BELOW", "offset_kind": "PERCENT HWPUNIT",
}


def four(child: str) -> str:
    return ", ".join(f"int {child}.{side}=0" for side in ("left", "right", "top", "bottom"))


def points(n: int) -> str:
    return ", ".join(f"int pt{k}.{c}=0" for k in range(n) for c in "xy")


def seven(child: str, default: int) -> str:
    return ", ".join(f"int {child}.{g}={default}" for g in ("hangul", "latin", "hanja", "japanese", "other", "symbol", "user"))


PLACE = (
    "int id=0, int zOrder=0, numbering numberingType, wrap textWrap, flow textFlow, bool lock, int sz.width=0, size sz.widthRelTo, int sz.height=0, size sz.heightRelTo, bool sz.protect, "
    "bool pos.treatAsChar, bool pos.affectLSpacing, bool pos.flowWithText, bool pos.allowOverlap, relative pos.vertRelTo, relative pos.horzRelTo, vertical pos.vertAlign, horizontal pos.horzAlign, "
    "int pos.vertOffset=0, int pos.horzOffset=0, " + four("outMargin")
)
FRAME = "str href, int groupLevel=0, int instid, int offset.x=0, int offset.y=0, int orgSz.width=0, int orgSz.height=0, int curSz.width=0, int curSz.height=0, bool flip.horizontal, bool flip.vertical, num rotationInfo.angle=0"
PEN = (
    "colour lineShape.color, int lineShape.width=0, pen_line lineShape.style, end_cap lineShape.endCap, arrow lineShape.headStyle, arrow lineShape.tailStyle, bool lineShape.headfill, bool lineShape.tailfill, "
    "arrow_size lineShape.headSz, arrow_size lineShape.tailSz, outline_style lineShape.outlineStyle, int lineShape.alpha=0, shape_shadow shadow.type, colour shadow.color, int shadow.offsetX=0, int shadow.offsetY=0, int shadow.alpha=0"
)
SHAPE = f"{PLACE}, {FRAME}, {PEN}"
NOTE_FORMAT = (
    "number autoNumFormat.type, str autoNumFormat.userChar, str autoNumFormat.prefixChar, str autoNumFormat.suffixChar, bool autoNumFormat.supscript, %s numbering.type, int numbering.newNum=1, %s placement.place, bool placement.beneathText, "
    "int noteLine.length=0, wavy_line noteLine.type, str noteLine.width, colour noteLine.color, int noteSpacing.betweenNotes=0, int noteSpacing.belowLine=0, int noteSpacing.aboveLine=0"
)
HEAD = "int level=1, int start=1, align align, bool useInstWidth, bool autoIndent, int widthAdjust=0, offset_kind textOffsetType, int textOffset=0, number numFormat, int charPrIDRef, bool checkable, str ."
# Fields of elements.
ELEMENTS = {
    "secPr": "direction textDirection, int spaceColumns=0, int tabStop=8000, int outlineShapeIDRef, int memoShapeIDRef, int masterPageCnt, int grid.lineGrid=0, int grid.charGrid=0, bool grid.wonggojiFormat, starts_on startNum.pageStartsOn, "
    "int startNum.page=0, int startNum.pic=0, int startNum.tbl=0, int startNum.equation=0, bool visibility.hideFirstHeader, bool visibility.hideFirstFooter, visibility visibility.border, visibility visibility.fill, bool visibility.hideFirstPageNum, "
    "bool visibility.showLineNumber, line_restart lineNumberShape.restartType, int lineNumberShape.countBy=0, int lineNumberShape.distance=0, int lineNumberShape.startNumber=0",
    "pagePr": "landscape landscape, int width=59528, int height=84188, gutter gutterType, " + four("margin") + ", int margin.header=0, int margin.footer=0, int margin.gutter=0",
    "footNotePr": NOTE_FORMAT % ("note_restart", "note_place"), "endNotePr": NOTE_FORMAT % ("end_restart", "end_place"),
    "pageBorderFill": "str type, int borderFillIDRef=0, page_border textBorder, bool headerInside, bool footerInside, fill_area fillArea, " + four("offset"),
    "colPr": "int id=0, columns type, int colCount=1, column_layout layout, bool sameSz=1, int sameGap=0, {colSz: int width=0, int gap=0}",
    "header": "int id=0, apply applyPageType", "footer": "int id=0, apply applyPageType", "footNote": "int number, int instId", "endNote": "int number, int instId",
    "autoNum": "int num=0, auto_number numType, number autoNumFormat.type, str autoNumFormat.userChar, str autoNumFormat.prefixChar, str autoNumFormat.suffixChar",
    "newNum": "int num=0, auto_number numType", "bookmark": "str name", "compose": "str circleType, int charSz, str composeType, str composeText",
    "fieldBegin": "int id=0, field type, str name, bool editable, bool dirty, int fieldid, int zorder", "fieldEnd": "int beginIDRef, int fieldid",
    "parameters": "{integerParam: str name, str .}, {stringParam: str name, str .}", "dutmal": "ruby_place posType, int szRatio, int option, int styleIDRef, horizontal align, str mainText., str subText.",
    "subList": "int id=0, direction textDirection, vertical vertAlign, int textWidth, int textHeight, bool hasTextRef, bool hasNumRef",
    "tbl": PLACE + ", table_break pageBreak, bool repeatHeader, int rowCnt=0, int colCnt=0, int cellSpacing=0, int borderFillIDRef=0, bool noAdjust, " + four("inMargin") + ", {cellzone: int startRowAddr=0, int startColAddr=0, int endRowAddr=0, int endColAddr=0, int borderFillIDRef=0}",
    "tc": "str name, bool header, bool hasMargin, bool protect, bool editable, bool dirty, int borderFillIDRef=0, int cellAddr.colAddr=0, int cellAddr.rowAddr=0, int cellSpan.colSpan=1, int cellSpan.rowSpan=1, int cellSz.width=0, int cellSz.height=0, " + four("cellMargin"),
    "pic": f"{PLACE}, {FRAME}, bool reverse, str img.binaryItemIDRef, int img.bright=0, int img.contrast=0, effect img.effect, int img.alpha=0, int imgDim.dimwidth=0, int imgDim.dimheight=0, " + four("imgClip") + ", " + four("inMargin"),
    "imgRect": points(4), "line": SHAPE + ", bool isReverseHV, int startPt.x=0, int startPt.y=0, int endPt.x=0, int endPt.y=0", "rect": SHAPE + ", int ratio=0, " + points(4),
    "ellipse": SHAPE + ", bool intervalDirty", "arc": SHAPE + ", arc type", "polygon": SHAPE + ", {pt: int x=0, int y=0}", "curve": SHAPE + ", {seg: segment type, int x1=0, int y1=0, int x2=0, int y2=0}",
    "container": f"{PLACE}, {FRAME}", "equation": PLACE + ", str version, int baseLine, colour textColor, int baseUnit, str font, str script.",
    "ole": SHAPE + ", ole objectType, str binaryItemIDRef, bool hasMoniker, aspect drawAspect, int eqBaseLine, int extent.x=0, int extent.y=0",
    "connectLine": SHAPE + ", connector type, int startPt.x=0, int startPt.y=0, int startPt.subjectIDRef, int startPt.subjectIdx, int endPt.x=0, int endPt.y=0, int endPt.subjectIDRef, int endPt.subjectIdx", "point": "int x=0, int y=0, int type=0",
    "textart": SHAPE + ", str text, str textartPr.fontName, str textartPr.fontStyle, str textartPr.fontType, str textartPr.textShape, int textartPr.lineSpacing, int textartPr.charSpacing, align textartPr.align, " + points(4),
    "outline": "char_outline type, {pt: int x=0, int y=0}", "video": PLACE + ", video videotype, str fileIDRef, str imageIDRef, str tag", "caption": "side side, bool fullSz, int width=0, int gap=0, int lastWidth",
    "effects": "shadow_style shadow.style, num shadow.alpha=0, int shadow.radius=0, num shadow.direction=0, int shadow.distance=0, num glow.alpha=0, int glow.radius=0, int softEdge.radius=0, int reflection.radius=0, num reflection.direction=0, int reflection.distance=0",
    "lineseg": "int textpos=0, int vertpos=0, int vertsize=0, int textheight=0, int baseline=0, int spacing=0, int horzpos=0, int horzsize=0, int flags=0",
    "beginNum": "int page=1, int footnote=1, int endnote=1, int pic=1, int tbl=1, int equation=1",
    "font": "int id=0, str face, font type, bool isEmbedded, str binaryItemIDRef, str substFont.face, str typeInfo.familyType",
    "charPr": "int id=0, int height=1000, colour textColor, colour shadeColor, bool useFontSpace, bool useKerning, mark symMark, int borderFillIDRef, " + seven("fontRef", 0) + ", " + seven("ratio", 100) + ", " + seven("spacing", 0) + ", " + seven("relSz", 100) + ", " + seven("offset", 0)
    + ", underline underline.type, wavy_line underline.shape, colour underline.color, wavy_line strikeout.shape, colour strikeout.color, char_outline outline.type, char_shadow shadow.type, colour shadow.color, int shadow.offsetX=0, int shadow.offsetY=0",
    "borderFill": "int id=0, bool threeD, bool shadow, centre_line centerLine, bool breakCellSeparateLine, slash slash.type, bool slash.Crooked, bool slash.isCounter, slash backSlash.type, bool backSlash.Crooked, bool backSlash.isCounter, "
    + ", ".join(f"wavy_line {side}.type, str {side}.width, colour {side}.color" for side in ("leftBorder", "rightBorder", "topBorder", "bottomBorder", "diagonal")),
    "winBrush": "colour faceColor, colour hatchColor, hatch hatchStyle, int alpha=0", "gradation": "gradation type, int angle=0, int centerX=0, int centerY=0, int step=0, int colorNum=2, int stepCenter=50, int alpha=0, {color: colour value}",
    "imgBrush": "image_mode mode, str img.binaryItemIDRef, int img.bright=0, int img.contrast=0, effect img.effect, int img.alpha=0",
    "tabPr": "int id=0, bool autoTabLeft, bool autoTabRight, {tabItem: int pos=0, tab type, line leader}", "numbering": f"int id=0, int start=0, {{paraHead: {HEAD}}}", "bullet": f"int id=0, str char, str checkedChar, bool useImg, str img.binaryItemIDRef, {{paraHead: {HEAD}}}",
    "paraPr": "int id=0, int tabPrIDRef, int condense=0, bool fontLineHeight, bool snapToGrid, bool suppressLineNumbers, align align.horizontal, para_vertical align.vertical, heading heading.type, int heading.idRef=0, int heading.level=0, "
    "latin_break breakSetting.breakLatinWord, other_break breakSetting.breakNonLatinWord, bool breakSetting.widowOrphan, bool breakSetting.keepWithNext, bool breakSetting.keepLines, bool breakSetting.pageBreakBefore, line_wrap breakSetting.lineWrap, "
    "bool autoSpacing.eAsianEng, bool autoSpacing.eAsianNum, spacing lineSpacing.type, int lineSpacing.value=160, unit lineSpacing.unit, int border.borderFillIDRef=0, int border.offsetLeft=0, int border.offsetRight=0, int border.offsetTop=0, int border.offsetBottom=0",
    "margin": ", ".join(f"int {side}.value=0, unit {side}.unit" for side in ("intent", "left", "right", "prev", "next")),
    "style": "int id=0, style type, str name, str engName, int paraPrIDRef=0, int charPrIDRef=0, int nextStyleIDRef, int langID, bool lockForm",
}


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


@lru_cache(maxsize=None)
def names_of(kind: str) -> tuple[str, dict[str, str]]:
    """The default name of a list, and the name that each spelling means."""
    names = [n.split("|") for n in ENUMS[kind].split(" ")]
    return names[0][-1], {spelling: spellings[-1] for spellings in names for spelling in spellings}


@lru_cache(maxsize=None)
def split_fields(spec: str) -> list[tuple[str, str, str, str | None]]:
    """(kind, child, attribute, default) of each field; for lists of children ("children", child, fields, None)."""
    out: list = []
    for m in re.finditer(r"\{([A-Za-z]+): ([^}]*)\}|([a-z_]+) ([A-Za-z0-9.]+)(?:=(-?[0-9]+))?", spec):
        if m[1]:
            out.append(("children", m[1], m[2], None))
        else:
            child, _, attribute = m[4].rpartition(".")
            out.append((m[3], child, attribute, m[5]))
    return out


def value_of(kind: str, text: str | None, default: str | None):
    if kind == "str":
        return text or None
    if kind == "bool":
        return text in ("1", "true") if text is not None else default == "1"
    if kind == "colour":
        return int(text[1:], 16) if text and re.fullmatch("#[0-9A-Fa-f]{6}", text) else None
    if kind in ("int", "num"):
        try:
            return int(text) if kind == "int" else float(text)
        except (TypeError, ValueError):
            return None if default is None else int(default) if kind == "int" else float(default)
    first, names = names_of(kind)
    return names.get(text or "", first)


def read_fields(e: ElementTree.Element, spec: str) -> dict:
    inner: dict[str, ElementTree.Element] = {}
    for c in e:
        inner.setdefault(local(c.tag), c)
    out: dict = {}
    for kind, child, attribute, default in split_fields(spec):
        if kind == "children":
            out[child] = [read_fields(c, attribute) for c in e if local(c.tag) == child]
            continue
        at = inner.get(child) if child else e
        if at is not None:
            found = value_of(kind, at.get(attribute) if attribute else "".join(at.itertext()).strip(), default)
            if found is not None:
                out[(f"{child}.{attribute}" if child else attribute) or "text"] = found
    return out


def typed(e: ElementTree.Element) -> dict | None:
    """Fields of an element by name; None for elements without a layout."""
    spec = ELEMENTS.get(local(e.tag))
    return None if spec is None else read_fields(e, spec)
