"""Compound binary files: sector chains, directory, streams. Broken files raise DecodeError."""

from __future__ import annotations

import struct

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


class DecodeError(ValueError):
    """A file that can't be decoded; the message says why, and the kind in one word."""

    def __init__(self, message: str, kind: str = "format"):
        super().__init__(message)
        self.kind = kind


class Compound:
    """Streams by path ("DocInfo", "BodyText/Section0", ...). Only asked-for streams are read."""

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != SIGNATURE:
            raise DecodeError("not a compound file", "signature")
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift > shift:
            raise DecodeError("unknown sector size", "container")
        self.data, self.size, self.mini = data, 1 << shift, 1 << mini_shift
        _, first_dir, _, self.cutoff, first_mini_fat, _, first_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        fat_sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < END]
        for _ in range(n_difat):
            if first_difat >= END:
                break
            part = struct.unpack(f"<{self.size // 4}I", self.sector(first_difat))
            fat_sectors += [s for s in part[:-1] if s < END]
            first_difat = part[-1]
        self.fat = [x for s in fat_sectors for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        mini = self.chain(first_mini_fat)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self.entries = self.directory(self.chain(first_dir))
        self.mini_data = b""
        if self.entries and self.entries[0][1] == 5:
            self.mini_data = self.chain(self.entries[0][5])[: self.entries[0][6]]
        self.paths: dict[str, int] = {}
        self.walk(self.entries[0][4] if self.entries else FREE, "", set())

    def sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        part = self.data[at : at + self.size]
        if not part:
            raise DecodeError("sector outside the file", "cut_off")
        return part.ljust(self.size, b"\0")

    def chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < END:
            if n in seen or n >= len(self.fat):
                raise DecodeError("broken sector chain", "container")
            seen.add(n)
            out.append(self.sector(n))
            n = self.fat[n]
        return b"".join(out)

    @staticmethod
    def directory(raw: bytes) -> list[tuple]:
        out = []
        for at in range(0, len(raw) - 127, 128):
            name_size, kind = struct.unpack_from("<HB", raw, at + 64)
            left, right, child = struct.unpack_from("<III", raw, at + 68)
            start, size = struct.unpack_from("<IQ", raw, at + 116)
            name = raw[at : at + max(0, min(name_size, 64) - 2)].decode("utf-16-le", "replace")
            out.append((name, kind, left, right, child, start, size & 0xFFFFFFFF))
        return out

    def walk(self, root: int, prefix: str, seen: set[int]) -> None:
        todo = [(root, prefix)]
        while todo:
            n, prefix = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            name, kind, left, right, child, _, _ = self.entries[n]
            todo += [(left, prefix), (right, prefix)]
            if kind == 2:
                self.paths[prefix + name] = n
            elif kind == 1:
                todo.append((child, f"{prefix}{name}/"))

    def find(self, path: str) -> int | None:
        """The entry of a stream: by its path, also below the root's name; else by its name among the entries that no folder links, as broken writers leave them."""
        for known in (path, path.removeprefix("Root Entry/"), f"Root Entry/{path}"):
            if known in self.paths:
                return self.paths[known]
        linked, name = set(self.paths.values()), path.split("/")[-1]
        return next((n for n, e in enumerate(self.entries) if e[1] == 2 and e[0] == name and n not in linked), None)

    def read(self, path: str) -> bytes | None:
        if (n := self.find(path)) is None:
            return None
        start, size = self.entries[n][5:7]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, seen = [], set()
        while start < END and len(out) * self.mini < size:
            if start in seen or start >= len(self.mini_fat):
                raise DecodeError("broken small-sector chain", "container")
            seen.add(start)
            out.append(self.mini_data[start * self.mini : (start + 1) * self.mini])
            start = self.mini_fat[start]
        return b"".join(out)[:size]
