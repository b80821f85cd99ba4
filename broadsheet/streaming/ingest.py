"""PAGE-XML documents as a stream: every page is by itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import page_xml


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parsed pages of the files that come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return page_xml.parse_pages(files.select(F.col("path").alias("page_id"), F.col("content").cast("string").alias("xml")))


def line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The text lines of those pages."""
    return page_xml.text_lines(page_stream(spark, folder, files_per_trigger))


def article_clusters(lines: DataFrame, out: str, checkpoint: str, **settings):
    """Starts a query that clusters the lines of each micro-batch and appends their tags to a table of files.

    Clustering joins lines of one page only, and a page comes whole in one batch.
    """
    from ..operators import clustering

    def batch(rows: DataFrame, number: int) -> None:
        tags = clustering.article_tags(clustering.cluster(rows, **settings))
        tags.write.mode("overwrite").parquet(f"{out}/batch={number}")  # again after a failure: the same folder

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
