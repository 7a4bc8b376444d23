"""Column expressions and windows over one price series for each entity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRADING_DAYS = 252
DAYS_PER_YEAR = 365.25


def horizon_days(years: float) -> int:
    """Days of a horizon, halves to even: 365, 1096, 1826 and 3652 for 1, 3, 5 and 10 years."""
    return round(years * DAYS_PER_YEAR)


def by_date(*keys: str):
    return W.partitionBy(*(keys or ("fund_id",))).orderBy("d")


def log_return(*keys: str) -> Column:
    """ln of the price over the one before; null at a series' start. Prices are positive."""
    return F.ln(F.col("nav") / F.lag("nav").over(by_date(*keys)))


def running_max(*keys: str) -> Column:
    return F.max("nav").over(by_date(*keys).rowsBetween(W.unboundedPreceding, 0))


def annual_vol(lr: Column) -> Column:
    return F.stddev_samp(lr) * math.sqrt(TRADING_DAYS)


def sharpe(cagr: Column, vol: Column, risk_free: float = 0.065) -> Column:
    """Null if either is null or the volatility is 0."""
    return F.when(vol != 0, (cagr - risk_free) / vol)


def cagr(growth: Column, days: Column) -> Column:
    return F.when((days > 0) & (growth > 0), F.pow(growth, F.lit(DAYS_PER_YEAR) / days) - 1)


def gap_days(*keys: str) -> Column:
    return F.datediff("d", F.lag("d").over(by_date(*keys)))


def splice_jumps(nav: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Days whose absolute log return is above the threshold."""
    return nav.withColumn("lr", log_return()).where(F.abs("lr") > threshold)


def rebase_to_100(nav: DataFrame) -> DataFrame:
    """Prices over the first price of the series, times 100."""
    first = F.first("nav").over(by_date().rowsBetween(W.unboundedPreceding, 0))
    return nav.withColumn("rebased", F.col("nav") / first * 100)
