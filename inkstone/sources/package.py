"""Zipped XML packages, decoded to the same rows as the binary format."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from xml.etree import ElementTree

from inkstone.functions.values import BORDER_MM
from inkstone.sources.compound import DecodeError
from inkstone.sources.elements import ENUMS, local, names_of, typed
from inkstone.sources.records import BODY_TABLES


def number(e: ElementTree.Element, name: str, default: int = 0) -> int:
    try:
        return int(e.get(name, default))
    except ValueError:
        return default


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError) as e:
            raise DecodeError(f"not a package: {e}", "container") from e
        self.names = set(self.zip.namelist())

    def part(self, name: str) -> bytes | None:
        if name not in self.names:
            return None
        try:
            return self.zip.read(name)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error) as e:
            raise DecodeError(f"part {name} is broken: {e}", "compression") from e

    def xml(self, name: str) -> ElementTree.Element | None:
        raw = self.part(name)
        if raw is None:
            return None
        if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
            raise DecodeError(f"part {name} declares entities", "entities")
        try:
            return ElementTree.fromstring(raw)
        except ElementTree.ParseError as e:
            raise DecodeError(f"part {name} isn't well-formed: {e}", "xml") from e

    def root(self) -> str:
        """The manifest's name."""
        root = "Contents/content.hpf"
        if (box := self.xml("META-INF/container.xml")) is not None:
            root = next((e.get("full-path", root) for e in box.iter() if local(e.tag) == "rootfile" and e.get("media-type", "application/hwpml-package+xml") == "application/hwpml-package+xml"), root)
        return root

    def manifest(self) -> tuple[dict, list[dict]]:
        """Metadata, and items (id, src, format)."""
        opf = self.xml(self.root())
        meta: dict = {}
        items: list[dict] = []
        for e in opf.iter() if opf is not None else ():
            name = local(e.tag)
            if name in ("title", "language"):
                meta[name] = (e.text or "").strip() or None
            elif name == "meta" and e.get("name"):
                meta[e.get("name").lower()] = (e.text or e.get("content") or "").strip() or None
            elif name == "item":
                src = e.get("href", "")
                items.append({"id": e.get("id", ""), "src": src, "format": src.rsplit(".", 1)[-1].lower() if "." in src else ""})
        return meta, items

    def sections(self) -> list[tuple[int, str]]:
        """Section parts by number; where there are none, those parts of the manifest that its spine names, in the spine's order."""
        found = sorted((int(m[1]), n) for n in self.names if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n)))
        if found:
            return found
        opf = self.xml(self.root())
        parts = {e.get("id"): e.get("href", "") for e in opf.iter() if local(e.tag) == "item"} if opf is not None else {}
        spine = [parts.get(e.get("idref"), "") for e in opf.iter() if local(e.tag) == "itemref"] if opf is not None else []
        return list(enumerate(n for n in spine if n.endswith(".xml") and "header" not in n and n in self.names))

    def version(self) -> str:
        e = self.xml("version.xml")
        return "" if e is None else ".".join(e.get(k, "0") for k in ("major", "minor", "micro", "buildNumber"))


# Codes of the binary format for the names of this one, by place.
ALIGNS, HEADINGS, LINE_CODES, TABS, LEADERS = (tuple(names_of(k)[1].values()) for k in ("align", "heading", "wavy_line", "tab", "line"))
NUMBER_CODES = tuple(ENUMS["number"].split(" "))
SIDES = (("left", "leftBorder"), ("right", "rightBorder"), ("top", "topBorder"), ("bottom", "bottomBorder"))


def width_code(text: str | None) -> int:
    """The code of a line width like 0.12 mm."""
    m = re.match(r"[0-9.]+", text or "")
    return BORDER_MM.index(float(m[0])) if m and float(m[0]) in BORDER_MM else 1


def bgr(rgb: int | None) -> int | None:
    return None if rgb is None else (rgb & 255) << 16 | rgb & 0xFF00 | rgb >> 16


def margins(e: ElementTree.Element) -> dict:
    """Margins of a paragraph shape, which newer files wrap in a choice of layouts; the first counts."""
    found = next((x for x in e.iter() if local(x.tag) == "margin"), None)
    f = typed(found) if found is not None else {}
    return {name: f.get(f"{side}.value", 0) for name, side in (("left", "left"), ("right", "right"), ("indent", "intent"), ("before", "prev"), ("after", "next"))}


def head(root: ElementTree.Element | None) -> dict[str, list[dict]]:
    """Dimension rows of header.xml, in the codes of the binary format. Numberings and bullets count from 1, as paragraphs name them."""
    out: dict[str, list[dict]] = {k: [] for k in ("fonts", "char_shapes", "para_shapes", "styles", "numberings", "bullets", "border_fills", "bin_items", "tab_defs", "settings")}
    for e in root.iter() if root is not None else ():
        name = local(e.tag)
        if name not in ("beginNum", "font", "charPr", "paraPr", "style", "numbering", "bullet", "borderFill", "tabPr"):
            continue
        f, inner = typed(e) or {}, {local(c.tag): c for c in e}
        if name == "beginNum":
            out["settings"].append({k: f[v] for k, v in (("page_start", "page"), ("footnote_start", "footnote"), ("endnote_start", "endnote"), ("picture_start", "pic"), ("table_start", "tbl"), ("equation_start", "equation"))})
        elif name == "font":
            out["fonts"].append({"id": f["id"], "name": f.get("face", ""), "substitute": f.get("substFont.face"), "standard": None, "facts": f.get("typeInfo.familyType")})
        elif name == "charPr":
            colour = e.get("textColor", "#000000")
            metrics = {k: [f.get(f"{part}.{g}", default) for g in ("hangul", "latin", "hanja", "japanese", "other", "symbol", "user")] for k, part, default in (("fonts", "fontRef", 0), ("ratios", "ratio", 100), ("spacings", "spacing", 0), ("sizes", "relSz", 100), ("offsets", "offset", 0))}
            out["char_shapes"].append({
                "id": f["id"], "height": f["height"], "italic": "italic" in inner, "bold": "bold" in inner, "underline": {"BOTTOM": 1, "CENTER": 2, "TOP": 3}.get(f.get("underline.type", "NONE"), 0),
                "strike": int("strikeout" in inner and inner["strikeout"].get("shape", "NONE") not in ("NONE", "3D")), "colour": bgr(int(colour[1:], 16)) if re.fullmatch("#[0-9A-Fa-f]{6}", colour) else 0, "font": metrics["fonts"][0],
                "superscript": "supscript" in inner, "subscript": "subscript" in inner, "shade": bgr(f.get("shadeColor")), "border_fill": f.get("borderFillIDRef"), "metrics": json.dumps(metrics),
            })
        elif name == "paraPr":
            heading = HEADINGS.index(f.get("heading.type", "NONE"))
            out["para_shapes"].append({
                "id": f["id"], "align": ALIGNS.index(f.get("align.horizontal", "JUSTIFY")), "heading": heading, "level": min(f.get("heading.level", 0), 6) + 1, **margins(e),
                "spacing": next((number(x, "value", 160) for x in e.iter() if local(x.tag) == "lineSpacing"), 0), "numbering": f.get("heading.idRef", 0) + 1 if heading else 0, "tab_def": f.get("tabPrIDRef", 0), "border_fill": f.get("border.borderFillIDRef", 0),
            })
        elif name == "style":
            out["styles"].append({"id": f["id"], "name": f.get("name", ""), "english": f.get("engName", ""), "para_shape": f["paraPrIDRef"], "char_shape": f["charPrIDRef"]})
        elif name == "numbering":
            levels = f["paraHead"]
            out["numberings"].append({"id": len(out["numberings"]) + 1, "formats": [x.get("text", "") for x in levels], "kinds": [NUMBER_CODES.index(x["numFormat"]) for x in levels], "starts": [x["start"] for x in levels]})
        elif name == "bullet":
            out["bullets"].append({"id": len(out["bullets"]) + 1, "mark": f.get("char", ""), "image": int(f["useImg"])})
        elif name == "borderFill":
            bits = int(f["threeD"]) | int(f["shadow"]) << 1 | int(f["centerLine"] != "NONE") << 13
            fill = next((typed(x).get("faceColor") for x in e.iter() if local(x.tag) == "winBrush"), None)
            sides = {f"{side}_{k}": v for side, part in SIDES for k, v in (("line", LINE_CODES.index(f.get(f"{part}.type", "NONE"))), ("width", width_code(f.get(f"{part}.width"))), ("colour", bgr(f.get(f"{part}.color"))))}
            out["border_fills"].append({"id": f["id"], "bits": bits, **sides, "fill": bgr(fill)})
        elif name == "tabPr":
            tabs = [{"position": t["pos"], "kind": TABS.index(t["type"]), "fill": LEADERS.index(t["leader"])} for t in f["tabItem"]]
            out["tab_defs"].append({"id": f["id"], "bits": int(f["autoTabLeft"]) | int(f["autoTabRight"]) << 1, "tabs": json.dumps(tabs)})
    return out


MARKS = {"tab": "\t", "lineBreak": "\n", "hyphen": "-", "nbSpace": " ", "fwSpace": " "}
# The binary format's letters for controls and drawn objects.
CONTROLS = {
    "footNote": "fn  ", "endNote": "en  ", "header": "head", "footer": "foot", "tbl": "tbl ", "fieldBegin": "%", "fieldEnd": "%end", "autoNum": "atno", "newNum": "nwno", "secPr": "secd", "colPr": "cold", "equation": "eqed", "bookmark": "bokm",
    "dutmal": "tdut", "compose": "tcps", "pageHiding": "pghd", "pageNum": "pgnp", "hiddenComment": "tcmt", **dict.fromkeys(("pic", "rect", "line", "ellipse", "arc", "polygon", "curve", "container", "ole", "connectLine", "textart", "video"), "gso "),
}
NUMBER_KINDS = {"PAGE": "page", "FOOTNOTE": "footnote", "ENDNOTE": "endnote", "PICTURE": "image", "TABLE": "table", "EQUATION": "equation", "TOTAL_PAGE": "total_page"}
RESTARTS = {"CONTINUOUS": "continue", "ON_SECTION": "section", "ON_PAGE": "page"}


def control_row(path: str, e: ElementTree.Element) -> dict:
    """A control with what links, numbers and notes need of it, like those of the binary format."""
    name, f = local(e.tag), typed(e) or {}
    out: dict = {"path": path, "kind": CONTROLS[name], "fields": json.dumps(f, ensure_ascii=False)}
    if name == "fieldBegin":
        given = {k.get("name"): "".join(k.itertext()).strip() for k in e.iter() if local(k.tag) in ("stringParam", "integerParam")}
        out["kind"] = "%hlk" if f["type"] == "HYPERLINK" else "%" + f["type"].lower()
        out["target"] = given.get("Command") or f.get("name")
    elif name in ("autoNum", "newNum"):
        out |= {"number": f["num"], "number_kind": NUMBER_KINDS[f["numType"]], "number_shape": NUMBER_CODES.index(f.get("autoNumFormat.type", "DIGIT"))}
    elif name in ("footNote", "endNote"):
        out |= {"number": f.get("number"), "number_kind": name.lower()}
    elif name in ("header", "footer"):
        out["target"] = f["applyPageType"].lower()
    elif name in ("pic", "ole"):
        out["target"] = f.get("img.binaryItemIDRef") or f.get("binaryItemIDRef")
    elif name == "equation":
        out["target"] = f.get("script.")
    elif name == "bookmark":
        out["target"] = f.get("name")
    return out


def body(root: ElementTree.Element, section: int) -> dict[str, list[dict]]:
    """Rows of a section part."""
    out: dict[str, list[dict]] = {k: [] for k in BODY_TABLES}

    def paragraphs(parent: ElementTree.Element, container: str) -> None:
        k = 0
        for p in parent:
            if local(p.tag) == "subList":
                paragraphs(p, container)
            elif local(p.tag) == "p":
                paragraph(p, f"{container}.{k:06d}", container)
                k += 1

    def section_rows(e: ElementTree.Element) -> None:
        for x in e.iter():
            name = local(x.tag)
            if name == "pagePr":
                margin = next((m for m in x if local(m.tag) == "margin"), x)
                out["pages"].append({"section": section, "width": number(x, "width", 59528), "height": number(x, "height", 84188), **{k: number(margin, k) for k in ("left", "right", "top", "bottom", "header", "footer", "gutter")}, "landscape": x.get("landscape") == "LANDSCAPE"})
            elif name in ("footNotePr", "endNotePr"):
                f = typed(x)
                out["note_shapes"].append({"section": section, "ord": len(out["note_shapes"]), "kind": name[:-2].lower(), "restart": RESTARTS[f.get("numbering.type", "CONTINUOUS")], "start": f.get("numbering.newNum", 1), "shape": NUMBER_CODES.index(f.get("autoNumFormat.type", "DIGIT"))})

    def table_rows(e: ElementTree.Element, own: str) -> None:
        f = typed(e)
        out["tables"].append({"path": own, "rows": f["rowCnt"], "cols": f["colCnt"], "border_fill": f["borderFillIDRef"]})
        zones = (z for x in e.iter() if local(x.tag) == "cellzoneList" for z in x) if any(local(x.tag) == "cellzoneList" for x in e) else (x for x in e if local(x.tag) == "cellzone")
        out["zones"] += [{"path": own, "ord": n, "left": number(z, "startColAddr"), "top": number(z, "startRowAddr"), "right": number(z, "endColAddr"), "bottom": number(z, "endRowAddr"), "fill": number(z, "borderFillIDRef")} for n, z in enumerate(zones)]
        for cell in (c for tr in e if local(tr.tag) == "tr" for c in tr if local(c.tag) == "tc"):
            c = typed(cell)
            row, col = c.get("cellAddr.rowAddr", 0), c.get("cellAddr.colAddr", 0)
            held = f"{own}.r{row:03d}.k{col:03d}"
            out["cells"].append({"path": held, "table": own, "row": row, "col": col, "row_span": c.get("cellSpan.rowSpan", 1), "col_span": c.get("cellSpan.colSpan", 1), "width": c.get("cellSz.width", 0), "height": c.get("cellSz.height", 0), "border_fill": c["borderFillIDRef"]})
            paragraphs(cell, held)

    def paragraph(p: ElementTree.Element, path: str, container: str) -> None:
        out["paragraphs"].append({"path": path, "section": section, "container": container, "para_shape": number(p, "paraPrIDRef"), "style": number(p, "styleIDRef"), "page_break": p.get("pageBreak") == "1", "column_break": p.get("columnBreak") == "1"})
        order = [0, 0]

        def emit(kind: str, text: str, shape: int, control: str | None = None) -> None:
            if text or kind != "text":
                out["runs"].append({"path": path, "ord": order[0], "kind": kind, "text": text, "char_shape": shape, "control": control})
                order[0] += 1

        def control(e: ElementTree.Element, shape: int) -> None:
            name = local(e.tag)
            if name not in CONTROLS:
                for inner in e:
                    control(inner, shape)
                return
            own = f"{path}.c{order[1]:03d}"
            order[1] += 1
            row = control_row(own, e)
            out["controls"].append(row)
            emit(f"control:{name}", row["kind"], shape, own)
            if name == "secPr":
                section_rows(e)
                return
            lists = [x for x in e if local(x.tag) == "caption"]
            if name == "tbl":
                table_rows(e, own)
            for k, held in enumerate(lists):
                f = typed(held)
                out["captions"].append({"path": f"{own}.l{k:03d}", "control": own, "side": f["side"].lower(), "width": f["width"], "gap": f["gap"]})
                paragraphs(held, f"{own}.l{k:03d}")
            if name == "container":
                for inner in e:
                    control(inner, shape)
            elif name != "tbl":
                inner_lists = [x for c in e if local(c.tag) not in ("caption",) for x in ([c] if local(c.tag) == "subList" else [y for y in c if local(y.tag) == "subList"])]
                for k, sub in enumerate(inner_lists):
                    paragraphs(sub, f"{own}.l{k + len(lists):03d}")

        for run in p:
            name = local(run.tag)
            if name == "run":
                shape = number(run, "charPrIDRef")
                for e in run:
                    if local(e.tag) == "t":
                        emit("text", (e.text or "") + "".join(MARKS.get(local(m.tag), m.text or "") + (m.tail or "") for m in e), shape)
                    else:
                        control(e, shape)
            elif name == "linesegarray":
                for k, x in enumerate(run):
                    f = typed(x) or {}
                    out["line_segments"].append({"path": path, "segment": k, **{name: f.get(of, 0) for name, of in (("start", "textpos"), ("top", "vertpos"), ("height", "vertsize"), ("gap", "spacing"), ("left", "horzpos"), ("width", "horzsize"), ("flags", "flags"))}})

    paragraphs(root, f"{section:04d}")
    return out
