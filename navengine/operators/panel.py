"""Point-in-time returns panel over fiscal-year windows, in one pass over all windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import DAYS_PER_YEAR, annual_vol
from ..sources.catalog import bound_store
from ..sources.shared import written
from .identity import fund_map, spliced_nav

ANCHOR_DAYS = 15
DEATH_DAYS = 15


def fiscal_windows(spark: SparkSession, first_year: int, last_year: int, horizons: tuple[int, ...] = (1, 3)) -> DataFrame:
    """[April 1 of fy, March 31 of fy + h], for all that end by ``last_year``."""
    rows = [(h, fy, fy % h, dt.date(fy, 4, 1), dt.date(fy + h, 3, 31)) for h in horizons for fy in range(first_year, last_year - h + 1)]
    return spark.createDataFrame(rows, "horizon_y int, fy_start int, phase int, start_date date, end_date date")


def fiscal_year(date: str = "d") -> Column:
    """The year in which a day's fiscal year began on April 1."""
    return F.year(date) - F.when(F.month(date) < 4, 1).otherwise(0)


def fiscal_years(nav: DataFrame) -> tuple[int, int]:
    """The first fiscal year with prices, and the last end of one that the prices reach."""
    r = nav.agg(F.min(fiscal_year()).alias("a"), F.max(fiscal_year()).alias("b")).first()
    return r["a"], r["b"]


def by_year(windows: DataFrame) -> DataFrame:
    """``windows`` with __fy, a row for each fiscal year in them: years times horizons, some tens of rows."""
    return windows.withColumn("__fy", F.explode(F.sequence("fy_start", F.col("fy_start") + F.col("horizon_y") - 1)))


def returns_panel(nav: DataFrame, windows: DataFrame, key: str = "fund_id") -> DataFrame:
    """A row for each fund and window with an anchor: the latest price at most 15 days before the start.

    Observations are those after the start; coverage is their count over the
    median of all funds' counts in the window, taken before funds without an anchor go.
    """
    cols = ["horizon_y", "fy_start"]
    # A day lies in the windows of its fiscal year: an equi-join.
    slice_ = nav.select(key, "d", "nav", fiscal_year().alias("__fy")).join(F.broadcast(by_year(windows)), "__fy").where("d > start_date and d <= end_date").drop("__fy")
    w = W.partitionBy(key, *cols).orderBy("d")
    slice_ = slice_.withColumns({"lr": F.ln(F.col("nav") / F.lag("nav").over(w)), "top": F.max("nav").over(w.rowsBetween(W.unboundedPreceding, 0))})
    stats = slice_.groupBy(key, *cols, "phase", "start_date", "end_date").agg(
        F.max("d").alias("last_date"), F.max_by("nav", "d").alias("last_nav"), F.count(F.lit(1)).cast("int").alias("n_obs"),
        annual_vol(F.col("lr")).alias("ann_vol"), F.max(1 - F.col("nav") / F.col("top")).alias("max_drawdown"), F.max(F.abs("lr")).alias("max_abs_daily_lr"),
    )
    stats = written(stats, "stats")  # a row for each fund and window, read for the medians and for the panel
    middle = stats.groupBy(*cols).agg(F.median("n_obs").alias("__mid"))
    stats = stats.join(F.broadcast(middle), cols).withColumn("coverage_frac", F.least(F.col("n_obs") / F.col("__mid"), F.lit(1.0))).drop("__mid")
    # The few days before each start, some hundreds of rows: a price meets them by its date.
    before = windows.select("start_date").distinct().withColumn("d", F.explode(F.sequence(F.date_sub("start_date", ANCHOR_DAYS), F.col("start_date"))))
    anchors = nav.select(key, "d", "nav").join(F.broadcast(before), "d").groupBy(key, "start_date").agg(F.max(F.struct(F.col("d").alias("anchor_d"), F.col("nav").alias("anchor_nav"))).alias("__a"))
    out = stats.join(anchors.select(key, "start_date", "__a.*"), [key, "start_date"])
    growth, years = F.col("last_nav") / F.col("anchor_nav"), F.datediff("last_date", "anchor_d") / DAYS_PER_YEAR
    return out.select(
        key, *cols, "phase", "start_date", "end_date", F.col("anchor_d").alias("anchor_date"), "anchor_nav", F.datediff("start_date", "anchor_d").alias("anchor_gap_days"),
        "last_date", "last_nav", "n_obs", "coverage_frac", (growth - 1).alias("window_return"), F.when((years > 0.5) & (growth > 0), F.pow(growth, 1 / years) - 1).alias("cagr"),
        "ann_vol", "max_drawdown", years.alias("years_eff"), (F.col("last_date") >= F.date_sub("end_date", DEATH_DAYS)).alias("survived"), "max_abs_daily_lr",
    )


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("horizon_y").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("fund_id").alias("funds"), F.count_if("survived").alias("n_survived"),
        F.median("window_return").alias("med_return"), F.median("ann_vol").alias("med_vol"),
    )


def store_panel(tables: dict[str, DataFrame], windows: DataFrame, plan: str = "REGULAR", categories: list[str] | None = None) -> DataFrame:
    """The returns panel of a store, read through the roles of its columns."""
    nav, scheme = bound_store(tables)
    return returns_panel(spliced_nav(nav, fund_map(scheme, plan, categories)), windows)


def attrition(panel: DataFrame, horizon_y: int = 1) -> DataFrame:
    """(fy_start, n, n_survived, attrition_pct, med_return, med_vol): the windows of a horizon by their first year."""
    rows = panel.where(F.col("horizon_y") == horizon_y)
    out = rows.groupBy("fy_start").agg(F.count(F.lit(1)).alias("n"), F.count_if("survived").alias("n_survived"), F.median("window_return").alias("med_return"), F.median("ann_vol").alias("med_vol"))
    return out.withColumn("attrition_pct", F.round(100.0 * (F.col("n") - F.col("n_survived")) / F.col("n"), 1))
