"""Document files from rows: zipped XML packages and compound binary files, the sinks that the sources read back."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame

CONTAINER = '<container><rootfiles><rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></rootfiles></container>'
HEADER = '<head><charPr id="0"/><paraPr id="0"/></head>'
#: All parts carry one date, so that equal texts give equal files.
DATE = (1980, 1, 1, 0, 0, 0)


def package_bytes(paragraphs: list[str]) -> bytes:
    section = "<sec>" + "".join(f'<p paraPrIDRef="0"><run charPrIDRef="0"><t>{escape(p)}</t></run></p>' for p in paragraphs) + "</sec>"
    parts = {"version.xml": '<v major="5" minor="1" micro="0" buildNumber="0"/>', "META-INF/container.xml": CONTAINER, "Contents/content.hpf": "<package/>", "Contents/header.xml": HEADER, "Contents/section0.xml": section}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, DATE), text, zipfile.ZIP_DEFLATED)  # an entry is stored as it is, unless told here
    return out.getvalue()


def to_packages(df: DataFrame, path: Column, paragraphs: Column) -> DataFrame:
    """path, content: a package for each row, whose paragraphs are an array of texts."""

    def run(batches):
        for batch in batches:
            files = [package_bytes([t or "" for t in p or []]) for p in batch.column("paragraphs").to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "content": pa.array(files, pa.binary())})

    return df.select(path.cast("string").alias("path"), paragraphs.alias("paragraphs")).mapInArrow(run, "path string, content binary")


def zip_bytes(parts: dict[str, bytes | str]) -> bytes:
    """A package of the given parts, the container and manifest added where they are missing."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in ({"version.xml": '<v major="5" minor="1" micro="0" buildNumber="0"/>', "META-INF/container.xml": CONTAINER, "Contents/content.hpf": "<package/>"} | parts).items():
            z.writestr(zipfile.ZipInfo(name, DATE), data)
    return out.getvalue()


SECTOR, SMALL, LEAST_LARGE = 512, 64, 4096
END, NONE, FAT_SECTOR, DIFAT_SECTOR = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFC


def compound_bytes(streams: dict[str, bytes]) -> bytes:
    """A compound file of the given streams by path: small ones in the stream of small sectors, siblings of a folder as a chain."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def add(data: bytes) -> int:
        first, n = len(sectors), max(1, -(-len(data) // SECTOR))
        for k in range(n):
            sectors.append(data[k * SECTOR : (k + 1) * SECTOR].ljust(SECTOR, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else END)
        return first

    entries: list[list] = [["Root Entry", 5, 0, 0, []]]
    folders = {"": 0}
    small, small_fat = [], []
    for path in sorted(streams):
        *above, name = path.split("/")
        at = ""
        for folder in above:
            inner = f"{at}{folder}/"
            if inner not in folders:
                entries[folders[at]][4].append(len(entries))
                folders[inner] = len(entries)
                entries.append([folder, 1, 0, 0, []])
            at = inner
        data = streams[path]
        entries[folders[at]][4].append(len(entries))
        if len(data) < LEAST_LARGE:
            first, n = len(small_fat), max(1, -(-len(data) // SMALL))
            small.append(data.ljust(n * SMALL, b"\0"))
            small_fat += [first + k + 1 if k + 1 < n else END for k in range(n)]
        else:
            first = add(data)
        entries.append([name, 2, first, len(data), []])
    packed = b"".join(small)
    entries[0][2:4] = [add(packed) if packed else END, len(packed)]
    first_small_fat = add(struct.pack(f"<{len(small_fat)}I", *small_fat).ljust(SECTOR, b"\xff")) if small_fat else END
    after = {a: b for e in entries for a, b in zip(e[4], e[4][1:], strict=False)}
    raw = b""
    for n, (name, kind, start, size, inner) in enumerate(entries):
        coded = (name + "\0").encode("utf-16-le")
        raw += coded.ljust(64, b"\0") + struct.pack("<HBBIII", len(coded), kind, 1, NONE, after.get(n, NONE), inner[0] if inner else NONE) + bytes(36) + struct.pack("<IQ", start, size)
    first_entry = add(raw)
    n_fat = n_difat = 0
    while n_fat * 128 < len(fat) + n_fat + n_difat:
        n_fat += 1
        n_difat = max(0, -(-(n_fat - 109) // 127))
    at = len(sectors)
    table = fat + [FAT_SECTOR] * n_fat + [DIFAT_SECTOR] * n_difat
    table += [NONE] * (n_fat * 128 - len(table))
    sectors += [struct.pack("<128I", *table[k * 128 : (k + 1) * 128]) for k in range(n_fat)]
    places = [at + k for k in range(n_fat)]
    for k in range(n_difat):
        part = places[109 + 127 * k : 109 + 127 * (k + 1)]
        sectors.append(struct.pack("<128I", *part, *[NONE] * (127 - len(part)), at + n_fat + k + 1 if k + 1 < n_difat else END))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, n_fat, first_entry, 0, LEAST_LARGE, first_small_fat, -(-len(small_fat) // 128), at + n_fat if n_difat else END, n_difat)
    return head + struct.pack("<109I", *(places + [NONE] * 109)[:109]) + b"".join(sectors)


def file_header_bytes(flags: int = 0, version: int = 0x05010000, license_flags: int = 0) -> bytes:
    return (b"HWP Document File".ljust(32, b"\0") + struct.pack("<III", version, flags, license_flags)).ljust(256, b"\0")


def deflated(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def to_files(df: DataFrame, path: Column, parts: Column, kind: str = "compound", compress: tuple[str, ...] = ()) -> DataFrame:
    """path, content: a compound file or a package for each row. parts: map of stream or part names to bytes; names that begin with one of compress are deflated."""
    make = compound_bytes if kind == "compound" else zip_bytes

    def run(batches):
        for batch in batches:
            files = [make({k: deflated(v or b"") if compress and k.startswith(compress) else v or b"" for k, v in row or ()}) for row in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "content": pa.array(files, pa.binary())})

    return df.select(path.cast("string").alias("path"), parts.alias("parts")).mapInArrow(run, "path string, content binary")
