"""Diagnoses of a store and of a run: gaps by day and source, labels, offenders, what a merge adds, and whether a test has enough pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import DAYS_PER_YEAR
from . import trailing


def gaps_by_day(scheme: DataFrame) -> DataFrame:
    """Codes and those without a category, by the day of their last update and their source."""
    n, missing = F.count(F.lit(1)), F.count_if(F.col("category").isNull())
    by = scheme.groupBy(F.col("updated_at").cast("date").alias("day"), "source")
    return by.agg(n.alias("n"), missing.alias("n_missing"), F.round(100.0 * missing / n, 1).alias("pct_missing"))


def label_lineage(nav: DataFrame, funds: DataFrame, asof: str, years: int) -> DataFrame:
    """Each fund (fund_id, category) with its history and what a window of ``years`` makes of it: no anchor, dead or alive, with growth a year."""
    span = nav.groupBy("fund_id").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    window = trailing.trailing(nav, asof, years).select("fund_id", "is_dead", F.when(~F.col("is_dead"), F.col("cagr")).alias("cagr"))
    status = F.when(F.col("is_dead").isNull(), "no anchor").when(F.col("is_dead"), "dead").otherwise("alive")
    out = funds.join(span, "fund_id", "left").join(window, "fund_id", "left")
    return out.select("category", "fund_id", "first_d", "last_d", status.alias("status"), "cagr")


def label_status(lineage: DataFrame) -> DataFrame:
    """Funds of each label by status, as a snapshot of the category would count them."""
    return lineage.groupBy("category").pivot("status", ["alive", "dead", "no anchor"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"alive": "n_alive", "dead": "n_dead", "no anchor": "n_no_anchor"})


def repeat_offenders(jumps: DataFrame, least: int = 2) -> DataFrame:
    """Funds with at least ``least`` jumps: how many, the first and last day, and the largest log return."""
    out = jumps.groupBy("fund_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.max(F.abs("lr")).alias("largest"))
    return out.where(F.col("n") >= least)


def rows_around(nav: DataFrame, jumps: DataFrame, days: int = 10) -> DataFrame:
    """Each price within ``days`` of a jump, with the jump's day; buckets of time keep a fund's days from meeting all its jumps."""
    bucket = lambda d: F.floor(F.unix_date(d) / (days + 1))
    reach = F.explode(F.sequence(bucket(F.col("d")) - 1, bucket(F.col("d")) + 1)).alias("__b")
    near = jumps.select("fund_id", F.col("d").alias("jump_d"), reach)
    rows = nav.select("fund_id", "d", "nav", bucket(F.col("d")).alias("__b"))
    return rows.join(near, ["fund_id", "__b"]).where(F.abs(F.datediff("d", "jump_d")) <= days).select("fund_id", "jump_d", "d", "nav")


def merge_counts(current: DataFrame, batch: DataFrame, *key: str) -> DataFrame:
    """One row: distinct keys of the batch, those that are new, and those that replace a row."""
    known = current.select(*key).distinct().withColumn("__old", F.lit(True))
    keys = batch.select(*key).distinct().join(known, list(key), "left")
    return keys.agg(F.count(F.lit(1)).alias("n_batch"), F.count_if(F.col("__old").isNull()).alias("n_new"), F.count("__old").alias("n_replaced"))


def fill_counts(before: DataFrame, after: DataFrame, key: str, field: str) -> DataFrame:
    """One row: values missing before, filled by ``after``, and still missing."""
    both = before.select(key, F.col(field).alias("__was")).join(after.select(key, F.col(field).alias("__is")), key).where("__was is null")
    return both.agg(F.count(F.lit(1)).alias("n_missing"), F.count("__is").alias("n_filled"), F.count_if(F.col("__is").isNull()).alias("n_left"))


def persistence_run(panel: DataFrame, pairs: DataFrame, least: int = 50) -> DataFrame:
    """Of each horizon: windows, eligible pairs, their share, formation years with pairs, and whether there are enough for a test."""
    windows = panel.groupBy("horizon_y").agg(F.count(F.lit(1)).alias("n_windows"))
    found = pairs.groupBy("horizon_y").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("fy").alias("n_years"))
    out = windows.join(found, "horizon_y", "left").na.fill(0, ["n_pairs", "n_years"])
    return out.withColumns({"eligible_share": F.col("n_pairs") / F.col("n_windows"), "testable": F.col("n_pairs") >= least})


def pairs_by_year(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("horizon_y", "fy").agg(F.count(F.lit(1)).alias("n"))


def fund_windows(nav: DataFrame, asof: str, horizons: tuple[int, ...]) -> DataFrame:
    """Every fund with a window, for several horizons: a dead fund has the year it died in and no return, growth or length."""
    alive = lambda c: F.when(~F.col("is_dead"), c)
    rows = trailing.trailing_all(nav, asof, horizons)
    return rows.select(
        "fund_id", "horizon_y", "is_dead", F.when(F.col("is_dead"), F.year("last_d")).alias("death_year"), "anchor_d", "last_d", "stale_days",
        alive(F.col("window_return")).alias("window_return"), alive(F.col("cagr")).alias("cagr"), alive(F.datediff("last_d", "anchor_d") / DAYS_PER_YEAR).alias("actual_years"),
    )


def peer_table(nav: DataFrame, funds: DataFrame, asof: str, horizons: tuple[int, ...]) -> DataFrame:
    """Every fund (fund_id, category) and horizon on one row: growth, rank among living peers, and living and dead peers of its category."""
    w = W.partitionBy("category", "horizon_y")
    rows = fund_windows(nav, asof, horizons).join(funds, "fund_id")
    rows = rows.withColumns({"n_peers": F.count_if(~F.col("is_dead")).over(w), "n_dead_peers": F.count_if("is_dead").over(w), "rank": F.when(~F.col("is_dead"), F.rank().over(w.orderBy(F.desc_nulls_last("cagr"))))})
    percentile = F.when(F.col("rank").isNotNull(), F.when(F.col("n_peers") <= 1, 100.0).otherwise(F.round(100.0 * (F.col("n_peers") - F.col("rank")) / (F.col("n_peers") - 1), 1)))
    return rows.select("fund_id", "category", "horizon_y", "is_dead", "death_year", "window_return", "cagr", "rank", "n_peers", "n_dead_peers", percentile.alias("percentile"))


def codes_by_plan(fund_map: DataFrame) -> DataFrame:
    """(plan, category, n_codes, n_funds) of a fund map."""
    return fund_map.groupBy("plan", "category").agg(F.count(F.lit(1)).alias("n_codes"), F.count_distinct("fund_id").alias("n_funds"))
