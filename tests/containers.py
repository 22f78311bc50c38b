"""Writers of minimal document files, for tests only."""

import io
import struct
import zipfile
import zlib


def compound(streams: dict[str, bytes]) -> bytes:
    """A version 3 compound file; every stream is padded past the small-stream limit so that it lies in whole sectors, but for those of
    "mini" in their name, which lie in small sectors."""
    size, names = 512, ["Root Entry"]
    entries = [["Root Entry", 5, None, 0, 0]]
    storages: dict[str, int] = {}
    children: dict[int, list[int]] = {0: []}
    sectors: list[bytes] = []
    fat: list[int] = []
    mini, mini_fat = b"", []

    def add(data: bytes) -> int:
        first = len(sectors)
        n = max(1, -(-len(data) // size))
        for k in range(n):
            sectors.append(data[k * size : (k + 1) * size].ljust(size, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return first

    for path, data in streams.items():
        *folders, name = path.split("/")
        at = 0
        for f in folders:
            if f not in storages:
                storages[f] = len(entries)
                entries.append([f, 1, None, 0, 0])
                children[at].append(storages[f])
                children[storages[f]] = []
            at = storages[f]
        children[at].append(len(entries))
        if len(data) < 4096:
            first, n = len(mini_fat), max(1, -(-len(data) // 64))
            mini += data.ljust(n * 64, b"\0")
            mini_fat += [first + k + 1 if k + 1 < n else 0xFFFFFFFE for k in range(n)]
            entries.append([name, 2, None, first, len(data)])
        else:
            entries.append([name, 2, None, add(data), len(data)])
    entries[0][3:] = [add(mini), len(mini)]
    first_mini_fat = add(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(size, b"\xff"))
    raw = b""
    order = {n: kids for n, kids in children.items()}
    sibling = {kid: kids[i + 1] for kids in order.values() for i, kid in enumerate(kids[:-1])}
    for n, (name, kind, _, start, length) in enumerate(entries):
        coded = (name + "\0").encode("utf-16-le")
        child = order[n][0] if order.get(n) else 0xFFFFFFFF
        raw += coded.ljust(64, b"\0") + struct.pack("<HBBIII", len(coded), kind, 1, 0xFFFFFFFF, sibling.get(n, 0xFFFFFFFF), child) + bytes(36) + struct.pack("<IQ", start, length)
    first_dir = add(raw)
    n_fat = 1
    while n_fat * 128 < len(fat) + n_fat:
        n_fat += 1
    at = len(sectors)
    fat += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * size, b"\xff")
    sectors += [table[k * size : (k + 1) * size] for k in range(n_fat)]
    difat = [at + k for k in range(n_fat)] + [0xFFFFFFFF] * (109 - n_fat)
    header = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, first_dir, 0, 4096, first_mini_fat, 1, 0xFFFFFFFE, 0)
    return header + struct.pack("<109I", *difat) + b"".join(sectors)


def record(tag: int, level: int, data: bytes) -> bytes:
    if len(data) >= 0xFFF:
        return struct.pack("<II", tag | level << 10 | 0xFFF << 20, len(data)) + data
    return struct.pack("<I", tag | level << 10 | len(data) << 20) + data


def deflate(raw: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush()


def file_header(flags: int = 1) -> bytes:
    return (b"HWP Document File".ljust(32, b"\0") + struct.pack("<III", 0x05010001, flags, 0)).ljust(256, b"\0")


def char_shape(bold: bool = False, italic: bool = False) -> bytes:
    return bytes(42) + struct.pack("<iI", 1000, int(italic) | int(bold) << 1) + bytes(2) + struct.pack("<I", 255) + bytes(18)


def para_shape(heading: int = 0, level: int = 1, numbering: int = 0) -> bytes:
    return struct.pack("<Iiiiiii", heading << 23 | (level - 1) << 25, 0, 0, 0, 0, 0, 160) + struct.pack("<HHH", 0, numbering, 0) + bytes(20)


def paragraph(text: str, shape: int = 0, runs: tuple = ((0, 0),), level: int = 0, controls: bytes = b"") -> bytes:
    units = text.encode("utf-16-le")
    out = record(0x42, level, struct.pack("<IIHBBHHHI", len(units) // 2, 0, shape, 0, 0, len(runs), 0, 0, 0))
    out += record(0x43, level + 1, units)
    return out + record(0x44, level + 1, b"".join(struct.pack("<II", *r) for r in runs)) + controls


def table(cells: list[tuple[int, int, str]], level: int) -> bytes:
    out = record(0x47, level, b" lbt" + bytes(40)) + record(0x4D, level + 1, bytes(4) + struct.pack("<HH", 2, 2) + bytes(16))
    for row, col, text in cells:
        out += record(0x48, level + 1, bytes(8) + struct.pack("<HHHHII", col, row, 1, 1, 100, 50) + bytes(8) + struct.pack("<H", 0)) + paragraph(text, level=level + 1)
    return out


def package(sections: list[str], header: str, extra: dict[str, bytes] | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("version.xml", '<v major="5" minor="1" micro="0" buildNumber="1"/>')
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="{k.split("/")[-1].split(".")[0]}" href="{k}"/>' for k in extra or {})
        z.writestr("Contents/content.hpf", f"<package><metadata><title>T</title><meta name='creator'>me</meta></metadata><manifest>{items}</manifest></package>")
        z.writestr("Contents/header.xml", header)
        for k, s in enumerate(sections):
            z.writestr(f"Contents/section{k}.xml", s)
        for k, data in (extra or {}).items():
            z.writestr(k, data)
    return out.getvalue()
