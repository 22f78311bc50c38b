"""Record streams of the binary document format, decoded to flat rows keyed by path."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from inkstone.functions.text import CONTROL_INLINE, CONTROL_SINGLE
from inkstone.sources.compound import Compound, DecodeError
from inkstone.sources.layouts import caption, describe

HEADER_SIGNATURE = b"HWP Document File"
# Record tags.
DOCUMENT_PROPERTIES, BIN_DATA, FACE_NAME, BORDER_FILL, CHAR_SHAPE, TAB_DEF, NUMBERING, BULLET, PARA_SHAPE, STYLE = 0x10, 0x12, 0x13, 0x14, 0x15, 0x16, 0x17, 0x18, 0x19, 0x1A
SIDES = ("left", "right", "top", "bottom")
# List number types as codes of automatic numbers; kinds of automatic numbers by the low bits of their attribute.
LIST_KINDS = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 8: 8, 9: 10}
NUMBER_KINDS = ("page", "footnote", "endnote", "image", "table", "equation")
BODY_TABLES = ("paragraphs", "runs", "line_segments", "cells", "controls", "pages", "tables", "zones", "captions", "note_shapes")
PARA_HEADER, PARA_TEXT, PARA_CHAR_SHAPE, PARA_LINE_SEG, CTRL_HEADER, LIST_HEADER, PAGE_DEF, FOOTNOTE_SHAPE, TABLE, OLE, PICTURE, EQUATION = 0x42, 0x43, 0x44, 0x45, 0x47, 0x48, 0x49, 0x4A, 0x4D, 0x54, 0x55, 0x58
#: Control characters that stand alone; the others below 32 take eight units.
SINGLE = frozenset((0, 10, 13, 24, 25, 26, 27, 28, 29, 30, 31))
SHOWN = {9: "\t", 10: "\n", 24: "-", 30: " ", 31: " "}


@dataclass
class Record:
    tag: int
    level: int
    data: bytes


def records(raw: bytes) -> Iterator[Record]:
    """Ten bits of tag, ten of level, twelve of size; a size of 4095 is followed by the real one."""
    at = 0
    while at + 4 <= len(raw):
        head = struct.unpack_from("<I", raw, at)[0]
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(raw):
                raise DecodeError("record header cut off", "cut_off")
            size = struct.unpack_from("<I", raw, at)[0]
            at += 4
        if at + size > len(raw):
            raise DecodeError("record cut off", "cut_off")
        yield Record(head & 0x3FF, (head >> 10) & 0x3FF, raw[at : at + size])
        at += size


def inflate(raw: bytes) -> bytes:
    try:
        return zlib.decompress(raw, -15)
    except zlib.error as e:
        try:
            return zlib.decompress(raw)
        except zlib.error:
            raise DecodeError(f"compressed stream is broken: {e}", "compression") from e


def inflate_prefix(raw: bytes) -> bytes:
    """The compressed stream at the start of raw; a cipher's last block may leave bytes behind it."""
    d = zlib.decompressobj(-15)
    try:
        return d.decompress(raw) + d.flush()
    except zlib.error as e:
        raise DecodeError(f"compressed stream is broken: {e}", "compression") from e


@dataclass
class FileHeader:
    version: str
    flags: int
    license_flags: int

    @staticmethod
    def parse(raw: bytes | None) -> FileHeader:
        if raw is None or len(raw) < 44:
            raise DecodeError("file header is missing or short", "missing")
        if not raw.startswith(HEADER_SIGNATURE):
            raise DecodeError("file header has another signature", "signature")
        v, flags, license_flags = struct.unpack_from("<III", raw, 32)
        return FileHeader(".".join(str(v >> s & 0xFF) for s in (24, 16, 8, 0)), flags, license_flags)

    @property
    def compressed(self) -> bool:
        return bool(self.flags & 1)

    @property
    def encrypted(self) -> bool:
        return bool(self.flags & 2)

    @property
    def protected(self) -> bool:
        return bool(self.flags & 4)


def lcg_stream(seed: int):
    """The format's key schedule: 15 bits a step."""
    state = seed
    while True:
        state = (state * 214013 + 2531011) & 0xFFFFFFFF
        yield state >> 16 & 0x7FFF


def protected_key(payload: bytes) -> tuple[bytes, int]:
    """The 16-byte key hidden in the 256 bytes of a protected body, and the place it was found at."""
    if len(payload) < 256:
        raise DecodeError("protected header is short", "cut_off")
    seed = struct.unpack_from("<I", payload)[0]
    rand, out, left, value = lcg_stream(seed), bytearray(payload[:256]), 0, 0
    for i in range(256):
        if not left:
            value, left = next(rand) & 0xFF, (next(rand) & 0xF) + 1
        if i >= 4:
            out[i] ^= value
        left -= 1
    at = 4 + (seed & 0xF)
    return bytes(out[at : at + 16]), at


def text16(raw: bytes, at: int) -> tuple[str, int]:
    """A string of two-byte units with its count in front."""
    n = struct.unpack_from("<H", raw, at)[0]
    return raw[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"), at + 2 + 2 * n


def pieces_of_text(raw: bytes) -> list[tuple[int, str, bytes | str]]:
    """(unit offset, kind, text) of a paragraph's text: runs of text, still as units, and control marks.

    Marks hold what they carry: a tab its width, other inline marks their letters, the rest the control's four letters."""
    n = len(raw) // 2
    units = struct.unpack(f"<{n}H", raw[: 2 * n])
    out: list = []
    at = begin = 0
    while at < n:
        u = units[at]
        if u >= 32:
            at += 1
            continue
        if at > begin:
            out.append((begin, "text", raw[2 * begin : 2 * at]))
        data = raw[2 * at + 2 : 2 * at + 6]
        if u in SHOWN:
            out.append((at, "text", SHOWN[u].encode("utf-16-le")))
        elif u in CONTROL_INLINE:
            out.append((at, f"control:{u}", data.rstrip(b"\0").decode("ascii") if all(b == 0 or 32 <= b < 127 for b in data) else ""))
        elif u not in CONTROL_SINGLE:
            out.append((at, f"control:{u}", data[::-1].decode("latin-1") if len(data) == 4 else ""))
        at += 1 if u in CONTROL_SINGLE else 8
        begin = at
    if n > begin:
        out.append((begin, "text", raw[2 * begin : 2 * n]))
    return out


def doc_info(raw: bytes) -> dict[str, list[dict]]:
    """Dimension rows by table; ids count from 0 in stream order, those of border fills, numberings and bullets from 1."""
    out: dict[str, list[dict]] = {k: [] for k in ("fonts", "char_shapes", "para_shapes", "styles", "numberings", "bullets", "border_fills", "bin_items", "tab_defs", "settings")}
    for r in records(raw):
        d = r.data
        if r.tag == DOCUMENT_PROPERTIES:
            f = describe(r.tag, d)[1]
            out["settings"].append({k: f.get(k) for k in ("page_start", "footnote_start", "endnote_start", "picture_start", "table_start", "equation_start")})
        elif r.tag == FACE_NAME and len(d) >= 3:
            f = describe(r.tag, d)[1]
            out["fonts"].append({"id": len(out["fonts"]), "name": f.get("name", ""), "substitute": f.get("substitute"), "standard": f.get("standard"), "facts": json.dumps(f["facts"]) if f.get("facts") else None})
        elif r.tag == CHAR_SHAPE and len(d) >= 56:
            f = describe(r.tag, d)[1]
            bits = f["attribute"]
            out["char_shapes"].append({
                "id": len(out["char_shapes"]), "height": f["height"], "italic": bool(bits & 1), "bold": bool(bits >> 1 & 1), "underline": bits >> 2 & 3, "strike": bits >> 18 & 7, "colour": f["colour"], "font": f["fonts"][0],
                "superscript": bool(bits >> 15 & 1), "subscript": bool(bits >> 16 & 1), "shade": f.get("shade_colour"), "border_fill": f.get("border_fill"), "metrics": json.dumps({k: f[k] for k in ("fonts", "ratios", "spacings", "sizes", "offsets")}),
            })
        elif r.tag == PARA_SHAPE and len(d) >= 34:
            f = describe(r.tag, d)[1]
            bits = f["attribute1"]
            out["para_shapes"].append({"id": len(out["para_shapes"]), "align": bits >> 2 & 7, "heading": bits >> 23 & 3, "level": (bits >> 25 & 7) + 1, **{k: f[k] for k in ("left", "right", "indent", "before", "after")}, "spacing": f.get("spacing", f["spacing_old"]), "numbering": f["numbering"], "tab_def": f["tab_def"], "border_fill": f.get("border_fill", 0)})
        elif r.tag == STYLE and len(d) >= 4:
            f = describe(r.tag, d)[1]
            out["styles"].append({"id": len(out["styles"]), "name": f.get("name", ""), "english": f.get("english", ""), "para_shape": f.get("para_shape", 0), "char_shape": f.get("char_shape", 0)})
        elif r.tag == NUMBERING:
            f = describe(r.tag, d)[1]
            levels = f.get("levels", [])
            out["numberings"].append({"id": len(out["numberings"]) + 1, "formats": [x["format"] for x in [*levels, *f.get("further", [])]], "kinds": [LIST_KINDS.get(x["attribute"] >> 5 & 15, 0) for x in levels], "starts": f.get("level_starts", f.get("starts", []))})
        elif r.tag == BULLET and len(d) >= 14:
            f = describe(r.tag, d)[1]
            out["bullets"].append({"id": len(out["bullets"]) + 1, "mark": d[12:14].decode("utf-16-le", "replace"), "image": f.get("image", 0)})
        elif r.tag == BORDER_FILL and len(d) >= 2:
            f = describe(r.tag, d)[1]
            sides = {f"{side}_{k}": b[k] for side, b in zip(SIDES, f.get("borders", []), strict=False) for k in ("line", "width", "colour")}
            out["border_fills"].append({"id": len(out["border_fills"]) + 1, "bits": f["attribute"], **sides, "fill": f.get("background")})
        elif r.tag == TAB_DEF and len(d) >= 4:
            f = describe(r.tag, d)[1]
            out["tab_defs"].append({"id": len(out["tab_defs"]), "bits": f["attribute"], "tabs": json.dumps([{k: t[k] for k in ("position", "kind", "fill")} for t in f.get("tabs", [])])})
        elif r.tag == BIN_DATA and len(d) >= 2:
            f = describe(r.tag, d)[1]
            if f.get("bin_item") is not None:
                out["bin_items"].append({"id": f"BIN{f['bin_item']:04X}", "format": f.get("extension", "").lower()})
    return out


#: Marks that a control header belongs to, one each in their order.
CONTROL_MARKS = frozenset(range(1, 32)) - CONTROL_SINGLE - CONTROL_INLINE


def control_row(path: str, raw: bytes) -> dict:
    """A control with what links, numbers and notes need of it: target, number, number_kind, number_shape; fields has everything."""
    name, f = describe(CTRL_HEADER, raw)
    out: dict = {"path": path, "kind": raw[:4][::-1].decode("latin-1"), "fields": json.dumps(f, ensure_ascii=False)}
    if name == "field":
        out["target"] = f.get("command")
    elif name in ("auto_number", "new_number"):
        bits = f.get("attribute", 0)
        out |= {"number": f.get("number"), "number_kind": NUMBER_KINDS[bits & 15] if bits & 15 < len(NUMBER_KINDS) else "unknown", "number_shape": bits >> 4 & 255}
    elif name in ("footnote", "endnote"):
        out |= {"number": f.get("number"), "number_kind": name}
    elif name == "bookmark":
        out["target"] = f.get("name")
    elif name in ("header", "footer"):
        out["target"] = ("both", "even", "odd", "both")[f.get("attribute", 0) & 3]
    return out


def body(raw: bytes, section: int) -> dict[str, list[dict]]:
    """Rows of a section: paragraphs, runs, line segments, cells and controls. Paths order like the document."""
    out: dict[str, list[dict]] = {k: [] for k in BODY_TABLES}
    #: Open containers: (level of their list header or control, path).
    counts: dict[str, int] = {}
    holders: list[tuple[int, str]] = [(-1, f"{section:04d}")]
    para, control, table = None, None, None
    columns = 1
    pending: dict | None = None

    def close() -> None:
        nonlocal pending
        if pending is None:
            return
        shapes = pending["shapes"] or [(0, 0)]
        ord_ = marks = 0
        for at, kind, text in pending["pieces"]:
            if kind != "text":
                row = {"path": pending["path"], "ord": ord_, "kind": kind, "text": text, "char_shape": shape_at(shapes, at)}
                if int(kind[8:]) in CONTROL_MARKS:
                    row["control"] = f"{pending['path']}.c{marks:03d}"
                    marks += 1
                out["runs"].append(row)
                ord_ += 1
                continue
            # Positions count units, so units are cut and then decoded.
            cuts = sorted({at, *(p for p, _ in shapes if at < p < at + len(text) // 2)})
            for a, b in zip(cuts, [*cuts[1:], at + len(text) // 2], strict=True):
                out["runs"].append({"path": pending["path"], "ord": ord_, "kind": "text", "text": text[2 * (a - at) : 2 * (b - at)].decode("utf-16-le", "replace"), "char_shape": shape_at(shapes, a)})
                ord_ += 1
        pending = None

    for r in records(raw):
        d = r.data
        if r.tag == PARA_HEADER:
            close()
            while len(holders) > 1 and holders[-1][0] >= r.level:
                holders.pop()
            path = holders[-1][1]
            n = counts[path] = counts.get(path, -1) + 1
            para = f"{path}.{n:06d}"
            mask, shape, style, split = struct.unpack_from("<IHBB", d, 4) if len(d) >= 12 else (0, 0, 0, 0)
            out["paragraphs"].append({"path": para, "section": section, "container": path, "para_shape": shape, "style": style, "page_break": bool(split & 4), "column_break": bool(split & 8), "mask": mask})
            pending = {"path": para, "pieces": [], "shapes": []}
        elif r.tag == PARA_TEXT and pending:
            pending["pieces"] = pieces_of_text(d)
        elif r.tag == PARA_CHAR_SHAPE and pending:
            pending["shapes"] = sorted(struct.unpack_from("<II", d, at) for at in range(0, len(d) - 7, 8))
        elif r.tag == PARA_LINE_SEG and para:
            for k, at in enumerate(range(0, len(d) - 35, 36)):
                v = struct.unpack_from("<IiiiiiiiI", d, at)
                out["line_segments"].append({"path": para, "segment": k, "start": v[0], "top": v[1], "height": v[2], "gap": v[5], "left": v[6], "width": v[7], "flags": v[8]})
        elif r.tag == CTRL_HEADER and len(d) >= 4:
            k = counts[f"{para}:control"] = counts.get(f"{para}:control", -1) + 1
            control = f"{para}.c{k:03d}"
            out["controls"].append(control_row(control, d))
            table = None
        elif r.tag == TABLE and len(d) >= 8:
            table, f = control, describe(TABLE, d)[1]
            columns = max(1, f.get("cols", 1))
            out["tables"].append({"path": control, "rows": f.get("rows"), "cols": f.get("cols"), "border_fill": f.get("border_fill")})
            out["zones"] += [{"path": control, "ord": n, **{k: z.get(k) for k in ("left", "top", "right", "bottom")}, "fill": z.get("border_fill")} for n, z in enumerate(f.get("zone_list", []))]
        elif r.tag == LIST_HEADER and control:
            k = counts[f"{control}:list"] = counts.get(f"{control}:list", -1) + 1
            path = f"{control}.l{k:03d}"
            if table == control:
                n = counts[f"{control}:cell"] = counts.get(f"{control}:cell", -1) + 1
                col, row, col_span, row_span, width, height = struct.unpack_from("<HHHHII", d, 8) if len(d) >= 34 else (n % columns, n // columns, 1, 1, 0, 0)
                path = f"{control}.r{row:03d}.k{col:03d}"
                out["cells"].append({"path": path, "table": control, "row": row, "col": col, "row_span": row_span, "col_span": col_span, "width": width, "height": height, "border_fill": struct.unpack_from("<H", d, 32)[0] if len(d) >= 34 else 0})
            elif out["controls"][-1]["kind"] == "tbl " and (f := caption(d)) is not None:
                out["captions"].append({"path": path, "control": control, "side": f["align"], "width": f["width"], "gap": f["gap"]})
            holders.append((r.level - 1, path))
        elif r.tag in (PICTURE, EQUATION, OLE) and control:
            f = describe(r.tag, d)[1]
            item = f.get("bin_item")
            out["controls"][-1]["target"] = f.get("script") if r.tag == EQUATION else f"BIN{item:04X}" if item is not None else None
        elif r.tag == FOOTNOTE_SHAPE and len(d) >= 26:
            f = describe(r.tag, d)[1]
            n = counts["notes"] = counts.get("notes", -1) + 1
            out["note_shapes"].append({"section": section, "ord": n, "kind": "endnote" if n % 2 else "footnote", "restart": ("continue", "section", "page", "continue")[f["attribute"] >> 10 & 3], "start": f["start"], "shape": f["attribute"] & 255})
        elif r.tag == PAGE_DEF and len(d) >= 40:
            v = struct.unpack_from("<10I", d)
            out["pages"].append({"section": section, "width": v[0], "height": v[1], "left": v[2], "right": v[3], "top": v[4], "bottom": v[5], "header": v[6], "footer": v[7], "gutter": v[8], "landscape": bool(v[9] & 1)})
    close()
    return out


def shape_at(shapes: list[tuple[int, int]], at: int) -> int:
    """The last shape that begins at or before; before the first, the first."""
    found = shapes[0][1]
    for p, s in shapes:
        if p <= at:
            found = s
    return found


def section_names(compound: Compound, storage: str) -> list[tuple[int, str]]:
    """Sections in the order of their numbers."""
    prefix = f"{storage}/Section"
    return sorted((int(p[len(prefix) :]), p) for p in compound.paths if p.startswith(prefix) and p[len(prefix) :].isdigit())
