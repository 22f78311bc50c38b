"""Protected (distribution) bodies: the key is unhidden at the decode boundary, the cipher is Spark's own, then bodies are decoded."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.sources import records
from inkstone.sources.compound import SIGNATURE, Compound, DecodeError
from inkstone.sources.documents import BODY, SCHEMAS


def sealed_sections(files: DataFrame) -> DataFrame:
    """file, section, key, sealed of every protected section of files (path, content)."""
    types = pa.schema([("file", pa.string()), ("section", pa.int64()), ("key", pa.binary()), ("sealed", pa.binary()), ("compressed", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    if content[:8] != SIGNATURE:
                        continue
                    c = Compound(content)
                    header = records.FileHeader.parse(c.read("FileHeader"))
                    for n, path in records.section_names(c, "ViewText") if header.protected else ():
                        raw = c.read(path)
                        size = struct.unpack_from("<I", raw)[0] >> 20
                        key, _ = records.protected_key(raw[4 : 4 + size])
                        sealed = raw[4 + size :]
                        rows.append({"file": file, "section": n, "key": key, "sealed": sealed[: len(sealed) // 16 * 16], "compressed": header.compressed})
                except (DecodeError, struct.error):
                    continue
            yield pa.RecordBatch.from_pylist(rows, types)

    return files.select(F.col("path").alias("file"), "content").mapInArrow(run, "file string, section long, key binary, sealed binary, compressed boolean")


def opened_sections(sealed: DataFrame) -> DataFrame:
    """file, section, raw: AES-128-ECB without padding, by appending a block of padding that the key itself encrypts."""
    pad = F.aes_encrypt(F.lit(b""), F.col("key"), F.lit("ECB"), F.lit("PKCS"))
    return sealed.select("file", "section", "compressed", F.aes_decrypt(F.concat("sealed", pad), F.col("key"), F.lit("ECB"), F.lit("PKCS")).alias("raw"))


def read_protected(files: DataFrame, table: str) -> DataFrame:
    """A body table of protected files, with the columns of inkstone.sources.documents.read_table."""
    if table not in BODY:
        raise ValueError(f"{table} is no body table")
    arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    columns = [c.split(" ") for c in SCHEMAS[table].split(", ")]
    types = pa.schema([("file", pa.string()), *((n, arrow[t]) for n, t in columns)])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    raw = records.inflate_prefix(r["raw"]) if r["compressed"] else r["raw"]
                    rows += [{"file": r["file"]} | row for row in records.body(raw, r["section"])[table]]
                except (DecodeError, struct.error):
                    continue
            yield pa.RecordBatch.from_pylist(rows, types)

    return opened_sections(sealed_sections(files)).mapInArrow(run, f"file string, {SCHEMAS[table]}")
