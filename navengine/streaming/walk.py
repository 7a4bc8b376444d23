"""An incremental walk through time: windows of days, each merged into a store that is partitioned by month.

A batch rewrites the months that its rows lie in and no others. Batches are logged with their windows, so the store knows how far
it reaches, and a batch that is merged twice changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import upsert_nav
from ..sources.shared import folder, read_or_none

NAV = "amfi_code int, nav_date date, nav double, month string"
BATCHES = "batch string, first_day date, last_day date, n_rows long, n_months long, at timestamp"


def date_windows(first: dt.date, last: dt.date, days: int = 90) -> list[tuple[dt.date, dt.date]]:
    """[first, last] in windows of so many days, the last one shorter; none if first is after last."""
    starts = range(0, (last - first).days + 1, days)
    return [(first + dt.timedelta(s), min(first + dt.timedelta(s + days - 1), last)) for s in starts]


def read_prices(spark: SparkSession, store: str) -> DataFrame:
    """(amfi_code, nav_date, nav, month), empty before the first batch."""
    found = read_or_none(spark, f"{store}/nav", NAV)
    return spark.createDataFrame([], NAV) if found is None else found


def batches(spark: SparkSession, store: str) -> DataFrame:
    found = read_or_none(spark, f"{store}/batches", BATCHES)
    return spark.createDataFrame([], BATCHES) if found is None else found


def high_water(spark: SparkSession, store: str) -> dt.date | None:
    """The last day up to which batches were merged without a gap from the first one; None before the first batch."""
    mark = None
    for r in batches(spark, store).select("first_day", "last_day").where("first_day is not null").distinct().orderBy("first_day", "last_day").toLocalIterator():
        if mark is not None and r["first_day"] > mark + dt.timedelta(1):
            break
        mark = r["last_day"] if mark is None else max(mark, r["last_day"])
    return mark


def plan(spark: SparkSession, store: str, first: dt.date, last: dt.date, days: int = 90, resume: bool = True) -> list[tuple[dt.date, dt.date]]:
    """The windows that are still to be walked: with ``resume`` from the day after the high-water mark, but not before ``first``."""
    mark = high_water(spark, store) if resume else None
    return date_windows(first if mark is None else max(first, mark + dt.timedelta(1)), last, days)


def merge(spark: SparkSession, store: str, rows: DataFrame, batch: str, first: dt.date, last: dt.date) -> int:
    """Merges (amfi_code, nav_date, nav, pos) by (code, date), the last pos winning, and logs the batch; how many months were rewritten.

    The merged months are written aside before they replace the old ones. A crash in between leaves months that are old or new;
    the batch is not logged then, and merging it again makes it whole. A batch that is logged is left out. Rows without a code or a date go.
    """
    if not batches(spark, store).where(F.col("batch") == batch).isEmpty():
        return 0
    new = rows.where("amfi_code is not null and nav_date is not null")
    month = F.date_format("nav_date", "yyyy-MM")
    counts = new.groupBy(month.alias("month")).count().collect()  # a row a month
    touched, n = [r["month"] for r in counts], sum(r["count"] for r in counts)
    if touched:
        old = read_prices(spark, store).where(F.col("month").isin(touched)).select("amfi_code", "nav_date", "nav")
        aside = folder(spark, "months")
        upsert_nav(old, new.select("amfi_code", "nav_date", "nav", "pos")).withColumn("month", month).write.parquet(aside)
        merged = spark.read.schema(NAV).parquet(aside)
        merged.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{store}/nav")
    done = spark.createDataFrame([(batch, first, last, n, len(touched), None)], BATCHES).withColumn("at", F.current_timestamp())
    done.coalesce(1).write.mode("append").parquet(f"{store}/batches")
    return len(touched)
