"""A drop folder of document files as a stream: decode what arrives, append, count in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import detect_format
from inkstone.sources.documents import read_table

FILES = "path string, modificationTime timestamp, length long, content binary"
#: What opening a file counts besides its bytes, where many small ones wait.
OPEN_COST = "64k"
#: Files of a batch where many wait. Each batch writes its list of files, and every tenth all lists so far, so small ones cost more the longer the folder is.
BACKLOG = 10_000


def arriving(spark: SparkSession, folder: str, per_batch: int = 100, take_away: bool = False) -> DataFrame:
    """New files below a folder: path, modificationTime, length, content. take_away deletes the files of a batch once it is committed."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    return files.option("cleanSource", "delete" if take_away else "off").load(folder)


def arriving_table(spark: SparkSession, folder: str, table: str, per_batch: int = 100, take_away: bool = False) -> DataFrame:
    """Rows of a table of the files that arrive. Numbers run within a file, so no state crosses batches."""
    return read_table(arriving(spark, folder, per_batch, take_away).select("path", "content"), table)


def backlog_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a folder where many small files wait: a task reads as many as their bytes allow, not one for each few,
    and a batch is listed by a few tasks, not by one for each file. Tasks stay bounded by spark.sql.files.maxPartitionBytes."""
    own = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    return own


def format_counts(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files by format in windows of their modification time; later ones than the watermark are dropped."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), detect_format(F.col("content")).alias("format")).agg(F.count("*").alias("n"))
