"""Plain files: CSV in and out, lists with one entry a line, and a log that only grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header, by a stated schema; an empty field is null."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """(query): the lines of a file without blank ones and those that start with #."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("query")).where("query <> '' and not query like '#%'")


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log; earlier ones are never touched."""
    rows.write.mode("append").parquet(path)
