"""Incremental ingest: new report files, or landed windows in their order, are merged into the store by month, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reports import history_report
from ..sources.windows import ReportWindows
from .walk import merge, read_prices


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """(amfi_code, nav_date, nav); empty before the first batch."""
    return read_prices(spark, store).select("amfi_code", "nav_date", "nav")


def ingest(spark: SparkSession, landing: str, store: str, checkpoint: str) -> None:
    """Reads the files that are new in ``landing`` and merges them into the months of the store that they touch.

    A batch is known by its files and their times, so one that is read again after a crash is merged once, and a new checkpoint, which
    reads all files again, changes nothing. Of a key's rows in a batch the last counts: by the
    file's time and name, the place of the block in the file and the row in it.
    """

    def take(batch: DataFrame, number: int) -> None:
        files = batch.groupBy("path", "at").agg(F.lit(1)).agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("path", "at")))).alias("id"), F.count(F.lit(1)).alias("n")).first()  # a row a file
        if files["n"]:
            place = F.struct("at", "path", "block", F.monotonically_increasing_id().alias("row"))
            rows = history_report(batch.withColumn("pos", place), "pos").select("amfi_code", "nav_date", "nav", "pos")
            days = rows.agg(F.min("nav_date").alias("first"), F.max("nav_date").alias("last")).first()
            merge(spark, store, rows, f"files-{files['id']}", days["first"], days["last"])

    place = [F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    stream = spark.readStream.text(landing).select("value", *place).writeStream.foreachBatch(take)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def walk(spark: SparkSession, landing: str, store: str, checkpoint: str, start: str, windows: int = 4) -> None:
    """Merges the landed windows that follow each other from ``start`` on into the store by month, up to ``windows`` a batch.

    After a killed run the stream goes on from its checkpoint: the batch that was under way is read again with the same windows and, being
    logged under its window's days, is merged once. Windows that land later than one after them wait for it; a row that comes in a later
    window replaces the price of its key.
    """
    spark.dataSource.register(ReportWindows)

    def take(batch: DataFrame, number: int) -> None:
        rows = history_report(batch.withColumn("place", F.struct("last_day", "pos")), "first_day", "last_day", "place").withColumnRenamed("place", "pos")
        days = batch.agg(F.min("first_day").alias("first"), F.max("last_day").alias("last")).first()
        if days["first"] is not None:
            merge(spark, store, rows, f"{days['first']}..{days['last']}", days["first"], days["last"])

    stream = spark.readStream.format("report_windows").option("start", start).option("windows", windows).load(landing)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
