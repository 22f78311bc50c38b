"""Document files end to end: pages are packed whole as document packages and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import render
from inkstone.plans.relations import read, spread
from inkstone.sources import documents
from inkstone.sources.writer import to_files, to_packages

#: Shares of the pages that arrive in the drop folder one after the other.
PORTIONS = 2
#: Folders that written files are dealt over, so that tasks don't wait for each other to enter a file's name.
FOLDERS = 64


def packed_pages(spark: SparkSession, d: str, pages: DataFrame | None = None) -> DataFrame:
    """path, content: a package for each page, its URL and its whole HTML as two paragraphs."""
    return to_packages(spread(read(spark, d, "pages"), "page_id") if pages is None else pages, F.col("page_id"), F.array("url", "html"))


def decode_packages(spark, d):
    found = documents.read_table(packed_pages(spark, d), "runs")
    return found.select(F.col("file").cast("long").alias("page_id"), "path", "text")


def package_markdown(spark, d):
    tables = documents.read_tables(packed_pages(spark, d), render.TEXT_TABLES)
    return render.document_text(tables).select(F.col("file").cast("long").alias("page_id"), F.col("text").alias("markdown"))


def batch_status_counts(spark, d):
    """Files that decode and files that don't: every third one is cut off."""
    files = packed_pages(spark, d)
    return documents.batch_status(files.withColumn("content", F.when(F.pmod(F.col("path").cast("long"), F.lit(3)) == 0, F.substring("content", 1, 200)).otherwise(F.col("content"))))


def file_versions(spark, d):
    return documents.read_table(packed_pages(spark, d), "headers").groupBy("format", "version").agg(F.count("*").alias("n"))


def written_packages(spark: SparkSession, d: str, folder: str | None = None, portion: tuple[int, int] = (0, 1)) -> str:
    """Packages of all pages as real files in a folder of their own, beside files of other kinds; portion (k, n): of the k-th of n shares.

    Each page is packed once for both its files. A table whose own partitions keep all cores busy is not dealt out anew, so that its texts aren't on disk twice."""
    folder, (k, n) = folder or documents.shared_folder(spark), portion
    pages = read(spark, d, "pages").where(F.coalesce(F.pmod("page_id", F.lit(n)), F.lit(0)) == k)
    if pages.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism:
        pages = spread(pages, "page_id")
    below = F.coalesce(F.pmod(F.hash("path"), F.lit(FOLDERS)), F.lit(0)).cast("string")
    one = lambda kind, data: F.struct(F.concat(F.lit("in/"), below, F.lit("/"), "path", F.lit(kind)).alias("name"), data.alias("data"))
    both = F.array(one(".hwpx", F.col("content")), one(".txt", F.lit(b"no document")))
    render.write_files(packed_pages(spark, d, pages).select(F.inline(both)), folder).write.format("noop").mode("overwrite").save()
    return folder


def page_of(file: str) -> Column:
    return F.regexp_extract(file, "([0-9]+)\\.hwpx$", 1).cast("long").alias("page_id")


def directory_scan(spark, d):
    """The documents below a folder, found by their extension, with the text of their first paragraph."""
    files = documents.scan(spark, written_packages(spark, d))
    return documents.read_table(files, "runs").where("path = '0000.000000'").select(page_of("file"), "text")


def command_line_info(spark, d):
    """What the command line's info shows of each file of a folder."""
    from inkstone import cli

    return cli.result(spark, "info", written_packages(spark, d)).select(page_of("file"), "version", "format", "sections", "paragraphs", "images")


def command_line_markdown(spark, d):
    from inkstone import cli

    return cli.result(spark, "to-markdown", written_packages(spark, d)).select(page_of("file"), F.col("text").alias("markdown"))


def drop_folder_stream(spark, d):
    """A stream over a drop folder, run until all files that have arrived are decoded. They arrive in portions; each time the stream goes on from its
    state. The folder is the query's own, so decoded files are taken away, and all files are never there at once."""
    from inkstone.streaming.folder import BACKLOG, arriving_table, backlog_session

    folder, state, out = (documents.shared_folder(spark) for _ in range(3))
    rows = arriving_table(backlog_session(spark), folder, "runs", BACKLOG, take_away=True)
    for k in range(PORTIONS):
        written_packages(spark, d, folder, (k, PORTIONS))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select(page_of("file"), "path", "text")


def event_time_counts(spark, d):
    """Files by format in windows of ten minutes of their time: events as files, whose first bytes follow their type."""
    from inkstone.streaming.folder import format_counts

    head = F.when(F.col("event_type") == "click", F.unhex(F.lit("D0CF11E0A1B11AE1"))).when(F.col("event_type") == "view", F.unhex(F.lit("504B0304"))).otherwise(F.unhex(F.lit("00")))
    files = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("modificationTime"), head.alias("content"))
    return format_counts(files).select(F.unix_seconds("window.start").alias("start"), "format", "n")


def written_pictures(spark, d):
    """Pictures of packages as files: their names below the folder, and their bytes."""
    item = '<package><manifest><item id="image1" href="BinData/image1.png"/></manifest></package>'
    parts = F.create_map(F.lit("Contents/content.hpf"), F.lit(item).cast("binary"), F.lit("BinData/image1.png"), F.col("html").cast("binary"))
    found = documents.read_table(to_files(read(spark, d, "pages"), F.col("page_id"), parts, "package"), "binaries")
    written = render.write_files(render.image_files(found), documents.shared_folder(spark))
    return written.select(F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("name"), "bytes")


def catalog() -> dict:
    decoded = "SELECT page_id, '0000.000000' AS path, url AS text FROM pages UNION ALL SELECT page_id, '0000.000001', html FROM pages"
    markdown = "SELECT page_id, url || chr(10) || chr(10) || replace(html, chr(10), '  ' || chr(10)) AS markdown FROM pages"
    return {
        "directory_scan": (directory_scan, "SELECT page_id, url AS text FROM pages"),
        "command_line_info": (command_line_info, "SELECT page_id, '5.1.0.0' AS version, 'package' AS format, CAST(1 AS BIGINT) AS sections, CAST(2 AS BIGINT) AS paragraphs, CAST(0 AS BIGINT) AS images FROM pages"),
        "command_line_markdown": (command_line_markdown, markdown),
        "drop_folder_stream": (drop_folder_stream, decoded),
        "event_time_counts": (event_time_counts, "SELECT epoch_us(ts) // 1000000 // 600 * 600 AS start, CASE event_type WHEN 'click' THEN 'compound' WHEN 'view' THEN 'package' ELSE 'unknown' END AS format, count(*) AS n FROM events GROUP BY 1, 2"),
        "written_pictures": (written_pictures, "SELECT CAST(page_id AS VARCHAR) || '-' || substring(md5(CAST(page_id AS VARCHAR)), 1, 8) || '/image1.png' AS name, CAST(strlen(html) AS BIGINT) AS bytes FROM pages"),
        "decode_packages": (decode_packages, decoded),
        "package_markdown": (package_markdown, markdown),
        "batch_status_counts": (batch_status_counts, "SELECT CASE WHEN page_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM pages GROUP BY 1"),
        "file_versions": (file_versions, "SELECT 'package' AS format, '5.1.0.0' AS version, count(*) AS n FROM pages"),
    }
