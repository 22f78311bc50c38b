"""Document files as tables. Each table decodes only the streams it needs; a broken file gives one row in `errors`, never a failed job."""

from __future__ import annotations

import base64
import json
import struct
import uuid
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.sources import elements, package, records
from inkstone.sources.compound import SIGNATURE, Compound, DecodeError
from inkstone.sources.layouts import describe

SCHEMAS = {
    "headers": "version string, format string, flags long, license_flags long",
    "meta": "key string, value string",
    "settings": "page_start long, footnote_start long, endnote_start long, picture_start long, table_start long, equation_start long",
    "fonts": "id long, name string, substitute string, standard string, facts string",
    "char_shapes": "id long, height long, italic boolean, bold boolean, underline long, strike long, colour long, font long, superscript boolean, subscript boolean, shade long, border_fill long, metrics string",
    "para_shapes": "id long, align long, heading long, level long, left long, right long, indent long, before long, after long, spacing long, numbering long, tab_def long, border_fill long",
    "styles": "id long, name string, english string, para_shape long, char_shape long",
    "numberings": "id long, formats array<string>, kinds array<long>, starts array<long>",
    "bullets": "id long, mark string, image long",
    "border_fills": "id long, bits long, " + ", ".join(f"{side}_{k} long" for side in records.SIDES for k in ("line", "width", "colour")) + ", fill long",
    "tab_defs": "id long, bits long, tabs string",
    "bin_items": "id string, format string",
    "paragraphs": "path string, section long, container string, para_shape long, style long, page_break boolean, column_break boolean, mask long",
    "runs": "path string, ord long, kind string, text string, char_shape long, control string",
    "line_segments": "path string, segment long, start long, top long, height long, gap long, left long, width long, flags long",
    "cells": "path string, table string, row long, col long, row_span long, col_span long, width long, height long, border_fill long",
    "controls": "path string, kind string, target string, number long, number_kind string, number_shape long, fields string",
    "tables": "path string, rows long, cols long, border_fill long",
    "zones": "path string, ord long, left long, top long, right long, bottom long, fill long",
    "captions": "path string, control string, side string, width long, gap long",
    "note_shapes": "section long, ord long, kind string, restart string, start long, shape long",
    "pages": "section long, width long, height long, left long, right long, top long, bottom long, header long, footer long, gutter long, landscape boolean",
    "binaries": "id string, format string, data binary",
    "preview": "text string, image string",
    "records": "stream string, seq long, parent long, level long, tag long, name string, fields string",
    "elements": "part string, seq long, parent long, depth long, name string, attributes string, text string, fields string",
    "scripts": "high long, low long, head string, source string, before string, after string",
    "templates": "schema_name string, schema string, instance string",
    "errors": "part string, kind string, error string",
}
DIMENSIONS = ("settings", "tab_defs", "fonts", "char_shapes", "para_shapes", "styles", "numberings", "bullets", "border_fills", "bin_items")
BODY = records.BODY_TABLES
# Property numbers of summary information, code pages.
SUMMARY = {2: "title", 3: "subject", 4: "creator", 5: "keywords", 6: "description", 8: "last_saved_by", 9: "revision", 12: "created", 13: "modified", 14: "pages"}
CODE_PAGES = {1200: "utf-16-le", 1201: "utf-16-be", 65001: "utf-8", 949: "cp949", 1252: "cp1252"}


def summary(raw: bytes) -> list[dict]:
    """Named properties of a summary stream; times nine hours ahead, as the format shows them."""
    if len(raw) < 48:
        raise DecodeError("summary is short", "cut_off")
    at = struct.unpack_from("<I", raw, 44)[0]
    count = struct.unpack_from("<I", raw, at + 4)[0]
    page, out = "utf-8", []
    places = [struct.unpack_from("<II", raw, at + 8 + 8 * k) for k in range(min(count, 200)) if at + 16 + 8 * k <= len(raw)]
    for key, offset in sorted(places):
        place = at + offset
        if place + 8 > len(raw):
            continue
        kind, value = struct.unpack_from("<II", raw, place)
        if key == 1:
            page = CODE_PAGES.get(value & 0xFFFF, page)
        elif key in SUMMARY:
            if kind == 31:
                text = raw[place + 8 : place + 8 + 2 * value].decode("utf-16-le", "replace").split("\0")[0]
            elif kind == 30:
                text = raw[place + 8 : place + 8 + value].decode(page, "replace").split("\0")[0]
            elif kind == 64 and place + 12 <= len(raw):
                ticks = struct.unpack_from("<Q", raw, place + 4)[0]
                text = (datetime(1601, 1, 1) + timedelta(microseconds=min(ticks, 2 * 10**18) // 10, hours=9)).strftime("%Y-%m-%dT%H:%M:%S+09:00")
            elif kind == 3:
                text = str(value)
            else:
                continue
            out.append({"key": SUMMARY[key], "value": text})
    return out


def record_rows(stream: str, raw: bytes) -> list[dict]:
    """Every record with its parent (the last record one level up) and its fields as JSON."""
    out, last = [], {}
    for seq, r in enumerate(records.records(raw)):
        name, fields = describe(r.tag, r.data)
        out.append({"stream": stream, "seq": seq, "parent": last.get(r.level - 1), "level": r.level, "tag": r.tag, "name": name, "fields": json.dumps(fields, ensure_ascii=False)})
        last[r.level] = seq
    return out


def element_rows(part: str, root) -> list[dict]:
    """Every XML element in document order, with its attributes as JSON."""
    out: list[dict] = []
    todo = [(root, None, 0)]
    while todo:
        e, parent, depth = todo.pop()
        seq = len(out)
        out.append({"part": part, "seq": seq, "parent": parent, "depth": depth, "name": elements.local(e.tag), "attributes": json.dumps({elements.local(k): v for k, v in e.attrib.items()}, ensure_ascii=False), "text": (e.text or "").strip() or None, "fields": None if (f := elements.typed(e)) is None else json.dumps(f, ensure_ascii=False)})
        todo += [(c, seq, depth + 1) for c in reversed(e)]
    return out


def counted_text(raw: bytes | None, at: int = 0) -> tuple[str | None, int]:
    """A text of two-byte units with its count in four bytes in front."""
    if raw is None or at + 4 > len(raw):
        return None, at
    n = struct.unpack_from("<I", raw, at)[0]
    return raw[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace") or None, at + 4 + 2 * n


def scripts(c: Compound) -> list[dict]:
    """The version of scripts and the default script's parts."""
    version, raw = c.read("Scripts/JScriptVersion"), c.read("Scripts/DefaultJScript")
    if version is None and raw is None:
        return []
    out: dict = dict(zip(("high", "low"), struct.unpack_from("<II", version), strict=True)) if version and len(version) >= 8 else {}
    at = 0
    for part in ("head", "source", "before", "after"):
        out[part], at = counted_text(raw, at)
    return [out]


def template(c: Compound) -> list[dict]:
    found = {k: counted_text(c.read(f"XMLTemplate/{name}"))[0] for k, name in (("schema_name", "_SchemaName"), ("schema", "Schema"), ("instance", "Instance"))}
    return [found] if any(found.values()) else []


class CompoundFile:
    """The tables of a compound file; each stream is read and decoded once at most."""

    def __init__(self, data: bytes):
        self.c = Compound(data)
        self.header = records.FileHeader.parse(self.c.read("FileHeader"))
        self.done: dict[str, dict[str, list[dict]]] = {}

    def stream(self, path: str) -> bytes | None:
        raw = self.c.read(path)
        return records.inflate(raw) if raw is not None and self.header.compressed else raw

    def table(self, name: str) -> list[dict]:
        h = self.header
        if name == "headers":
            return [{"version": h.version, "format": "compound", "flags": h.flags, "license_flags": h.license_flags}]
        if name == "meta":
            raw = self.c.read("\x05HwpSummaryInformation") or self.c.read("\x05SummaryInformation")
            return summary(raw) if raw else []
        if name == "preview":
            text, image = self.c.read("PrvText"), self.c.read("PrvImage")
            return [{"text": text.decode("utf-16-le", "replace") if text else None, "image": base64.b64encode(image).decode() if image else None}]
        if name in ("elements", "scripts", "templates"):
            return [] if name == "elements" else scripts(self.c) if name == "scripts" else template(self.c) if h.flags & 32 else []
        if h.encrypted:
            raise DecodeError("encrypted with a password", "encrypted")
        if name == "binaries":
            return list(self.binaries())
        if name == "records":
            return [row for s in ["DocInfo", *(p for _, p in records.section_names(self.c, "BodyText"))] if (raw := self.stream(s)) is not None for row in record_rows(s, raw)]
        part = "info" if name in DIMENSIONS else "body"
        if part not in self.done:
            self.done[part] = self.info() if part == "info" else self.body()
        return self.done[part][name]

    def info(self) -> dict[str, list[dict]]:
        if (raw := self.stream("DocInfo")) is None:
            raise DecodeError("document information is missing", "missing")
        return records.doc_info(raw)

    def body(self) -> dict[str, list[dict]]:
        if self.header.protected:
            raise DecodeError("protected body: decrypt it with inkstone.sources.protected first", "protected")
        out: dict[str, list[dict]] = {t: [] for t in BODY}
        for n, path in records.section_names(self.c, "BodyText"):
            for t, rows in records.body(self.stream(path), n).items():
                out[t] += rows
        return out

    def binaries(self):
        for path in sorted(p for p in self.c.paths if p.startswith("BinData/")):
            raw = self.c.read(path)
            try:
                data = records.inflate(raw) if self.header.compressed else raw
            except DecodeError:
                data = raw
            name = path.split("/")[-1]
            yield {"id": name.split(".")[0].upper(), "format": name.rsplit(".", 1)[-1].lower(), "data": data}


class PackageFile:
    """The tables of a package; each part is parsed once at most."""

    def __init__(self, data: bytes):
        self.p = package.Package(data)
        self.done: dict[str, dict[str, list[dict]]] = {}

    def table(self, name: str) -> list[dict]:
        p = self.p
        if name == "headers":
            return [{"version": p.version(), "format": "package", "flags": 0, "license_flags": 0}]
        if name == "meta":
            return [{"key": k, "value": v} for k, v in sorted(p.manifest()[0].items())]
        if name == "preview":
            text, image = p.part("Preview/PrvText.txt"), p.part("Preview/PrvImage.png")
            return [{"text": text.decode("utf-8", "replace") if text else None, "image": base64.b64encode(image).decode() if image else None}]
        if name in ("records", "scripts", "templates"):
            return []
        if name == "elements":
            return [row for n in ["version.xml", "settings.xml", "Contents/header.xml", *(n for _, n in p.sections())] if (root := p.xml(n)) is not None for row in element_rows(n, root)]
        if name == "bin_items":
            return [{"id": i["id"], "format": i["format"]} for i in p.manifest()[1] if i["src"].startswith("BinData/")]
        if name == "binaries":
            return [{"id": i["id"], "format": i["format"], "data": data} for i in p.manifest()[1] if i["src"].startswith("BinData/") and (data := p.part(i["src"])) is not None]
        part = "info" if name in DIMENSIONS else "body"
        if part not in self.done:
            self.done[part] = package.head(p.xml("Contents/header.xml")) if part == "info" else self.body()
        return self.done[part][name]

    def body(self) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {t: [] for t in BODY}
        for n, name in self.p.sections():
            for t, rows in package.body(self.p.xml(name), n).items():
                out[t] += rows
        return out


def opened(data: bytes | None) -> CompoundFile | PackageFile:
    if data and data[:8] == SIGNATURE:
        return CompoundFile(data)
    if data and data[:4] == b"PK\x03\x04":
        return PackageFile(data)
    raise DecodeError("unknown format", "signature")


def decode(data: bytes, table: str) -> list[dict]:
    """Rows of one table of a file."""
    return opened(data).table(table)


#: What a file is probed for: a failure of the first three makes it an error, one of the others is listed only.
PROBES = ("headers", "char_shapes", "paragraphs", "meta", "preview", "binaries", "records", "elements")


def failure(part: str, e: Exception) -> dict:
    return {"part": part, "kind": e.kind if isinstance(e, DecodeError) else type(e).__name__, "error": str(e)}


def errors_of(data: bytes | None) -> list[dict]:
    """The parts of a file that can't be decoded; whatever goes wrong with one file is its row here and no failure of the job."""
    try:
        file = opened(data)
    except Exception as e:  # noqa: BLE001
        return [failure("file", e)]
    out = []
    for part in PROBES:
        try:
            file.table(part)
        except Exception as e:  # noqa: BLE001
            out.append(failure(part, e))
    return out


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the document files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{hwp,hwpx}").load(folder).select("path", "content")


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
#: Rows in one Arrow batch of a decoder.
BATCH = 10_000


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in SCHEMAS[table].split(", ")]


def read_table(files: DataFrame, table: str) -> DataFrame:
    """file, and the columns of the table, for files (path, content). Broken files are left out here and listed in `errors`; files go out one by one."""
    names = [n for n, _ in columns_of(table)]
    source = files.select(F.col("path").alias("file"), "content")
    types = pa.schema([("file", pa.string()), *((n, ARROW[t]) for n, t in columns_of(table))])

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                try:
                    rows = errors_of(content.as_py()) if table == "errors" else decode(content.as_py(), table)
                except Exception:  # noqa: BLE001 - listed in errors
                    continue
                for at in range(0, len(rows), BATCH):
                    yield pa.RecordBatch.from_pylist([{"file": file.as_py()} | {k: r.get(k) for k in names} for r in rows[at : at + BATCH]], types)

    return source.mapInArrow(run, f"file string, {SCHEMAS[table]}")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, below spark.checkpoint.dir or else the warehouse; it is deleted when the driver ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/decoded-{uuid.uuid4().hex}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def read_tables(files: DataFrame, tables: tuple[str, ...], folder: str | None = None) -> dict[str, DataFrame]:
    """Several tables at once: each file is read and decoded once, its rows are written to a folder by table, and read from there.

    The folder is the caller's to delete; without one, the tables last as long as the driver."""
    spark = files.sparkSession
    folder = folder or shared_folder(spark)
    one = {t: pa.struct([(n, ARROW[k]) for n, k in columns_of(t)]) for t in tables}
    types = pa.schema([("file", pa.string()), ("table", pa.string()), *((t, one[t]) for t in tables)])
    source = files.select(F.col("path").alias("file"), "content")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                try:
                    opened_file = opened(content.as_py())
                except Exception:  # noqa: BLE001 - listed in errors
                    opened_file = None
                for t in tables:
                    try:
                        rows = errors_of(content.as_py()) if t == "errors" else opened_file.table(t) if opened_file else []
                    except Exception:  # noqa: BLE001 - listed in errors
                        continue
                    names = [n for n, _ in columns_of(t)]
                    for at in range(0, len(rows), BATCH):
                        yield pa.RecordBatch.from_pylist([{"file": file.as_py(), "table": t, t: {k: r.get(k) for k in names}} for r in rows[at : at + BATCH]], types)

    schema = "file string, table string, " + ", ".join(f"{t} struct<{', '.join(f'{n}: {k}' for n, k in columns_of(t))}>" for t in tables)
    source.mapInArrow(run, schema.replace("long", "bigint")).write.partitionBy("table").mode("overwrite").parquet(folder)
    every = spark.read.schema(schema.replace("long", "bigint")).parquet(folder)
    return {t: every.where(F.col("table") == t).select("file", f"{t}.*") for t in tables}


def batch_status(files: DataFrame) -> DataFrame:
    """status, n: how many files decode."""
    bad = read_table(files, "errors").where(F.col("part").isin("file", *PROBES[:3])).select(F.col("file").alias("path")).distinct()
    return files.select("path").join(bad.withColumn("status", F.lit("error")), "path", "left").groupBy(F.coalesce("status", F.lit("ok")).alias("status")).agg(F.count("*").alias("n"))
