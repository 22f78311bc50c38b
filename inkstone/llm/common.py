"""Shared helpers of the training-data operators: tables, shared storage, Arrow batches, label folds."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Whole texts cross to Python, so this and the next bound a worker's memory.
BATCH_ROWS = 1000
#: Bytes of a batch that are handled at a time.
BATCH_BYTES = 16 << 20


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, large ones in slices of rows; a single row is never cut."""
    for batch in batches:
        parts = min(batch.num_rows, -(-batch.nbytes // BATCH_BYTES))
        step = -(-batch.num_rows // parts) if parts > 1 else max(batch.num_rows, 1)
        for at in range(0, max(batch.num_rows, 1), step):
            yield batch.slice(at, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where it is unset, as in tests on one machine, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        base = tempfile.mkdtemp(prefix="inkstone-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Materialise in shared storage, so that a lost executor costs no recomputation of the lineage.

    The shuffles before are out of use then. The driver's JVM is asked to notice it, and Spark's cleaner deletes their files: jobs of many
    stages would otherwise keep every shuffle on disk to their end."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def put_shared_bytes(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Write one file into the shared folder through Hadoop's file system layer; return its URI. It is deleted when the driver ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}{suffix}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def delete_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches: of BATCH_ROWS rows, which Spark takes from the session's setting (it is lowered for all that follows in the
    session), and of about BATCH_BYTES."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(lambda batches: fn(bounded(batches)), schema)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text only: whatever else a table holds, clashing names included, never reaches an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n; null for a null doc_id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)
