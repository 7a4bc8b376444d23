"""As-of and nearest joins as equi-joins and aggregates.

Joins within a tolerance cut time into buckets one day longer than it, so that a probe looks into
two or three buckets of its series; no join here compares all dates of two series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import of_days, running


def last_at_or_before(nav: DataFrame, asof, key: str = "fund_id") -> DataFrame:
    """The last price of each entity up to one date (a literal date): filter and aggregate, no join."""
    return nav.where(F.col("d") <= F.lit(asof).cast("date")).groupBy(key).agg(F.max("d").alias("last_d"), F.max_by("nav", "d").alias("last_nav"))


def _bucket(date: Column, days: int) -> Column:
    return F.floor(F.unix_date(date) / (days + 1)).cast("int")


def _meet(probes: DataFrame, nav: DataFrame, date: str, before: int, after: int, key: str) -> DataFrame:
    """Distinct probes (key, date) with the prices (__d, __n) at most so many days before and after."""
    days = max(before, after)
    own = _bucket(F.col(date), days)
    buckets = F.explode(F.sequence(own - 1, own + (1 if after else 0))).alias("__b")
    asked = probes.select(key, date).distinct().select(key, date, buckets)
    prices = nav.select(key, F.col("d").alias("__d"), F.col("nav").alias("__n"), _bucket(F.col("d"), days).alias("__b"))
    return asked.join(prices, [key, "__b"]).where(F.col("__d").between(F.date_sub(date, before), F.date_add(date, after)))


def asof_bounded(probes: DataFrame, nav: DataFrame, probe_date: str, days: int, key: str = "fund_id") -> DataFrame:
    """Each probe (key, date) with the latest price on or before its date and at most ``days`` before it; probes without one stay."""
    keys = [key, probe_date]
    found = _meet(probes, nav, probe_date, days, 0, key).groupBy(*keys).agg(F.max(F.struct("__d", "__n")).alias("__m"))
    found = found.select(*keys, F.col("__m.__d").alias("anchor_d"), F.col("__m.__n").alias("anchor_nav"))
    return probes.join(found, keys, "left")


def asof_sweep(rows: DataFrame, events: DataFrame, value: str, key: str = "fund_id", days: int = 1024) -> DataFrame:
    """Each row with ``value`` of the last event of its key on or before its date: one sort of both, carried forward.

    Events on a row's own date come first. Series are cut into segments of ``days`` days, which hand their last event on,
    so that no task holds a whole series.
    """
    e = events.select(key, "d", F.lit(0).alias("__event"), F.col(value).alias("__value"))
    r = rows.drop(value).withColumns({"__event": F.lit(1), "__value": F.lit(None).cast(events.schema[value].dataType)})
    both = r.unionByName(e, allowMissingColumns=True)
    out = running(both, F.col("__value"), value, "last", [key], ["d", "__event"], of_days(days=days))
    return out.where("__event = 1").drop("__event", "__value")


def nearest_within(probes: DataFrame, nav: DataFrame, target: str, days: int, key: str = "fund_id") -> DataFrame:
    """Each probe with the price nearest to its date, at most ``days`` away on either side; the later date wins ties. Probes without one go."""
    best = F.max(F.struct((-F.abs(F.datediff("__d", target))).alias("near"), "__d", "__n")).alias("__m")
    keys = [key, target]
    found = _meet(probes, nav, target, days, days, key).groupBy(*keys).agg(best)
    found = found.select(*keys, F.col("__m.__d").alias("anchor_d"), F.col("__m.__n").alias("anchor_nav"))
    return probes.join(found, keys)


def nearest_by_row(probes: DataFrame, nav: DataFrame, target: str, days: int, row: list[str], key: str = "fund_id") -> DataFrame:
    """``nearest_within`` for probes that are known by the columns ``row``: they pass through the one join and one aggregate and are not joined again."""
    own = _bucket(F.col(target), days)
    asked = probes.select(*row, F.explode(F.sequence(own - 1, own + 1)).alias("__b"))
    prices = nav.select(key, F.col("d").alias("__d"), F.col("nav").alias("__n"), _bucket(F.col("d"), days).alias("__b"))
    met = asked.join(prices, [key, "__b"]).where(F.col("__d").between(F.date_sub(target, days), F.date_add(target, days)))
    best = F.max(F.struct((-F.abs(F.datediff("__d", target))).alias("near"), "__d", "__n")).alias("__m")
    return met.groupBy(*row).agg(best).select(*row, F.col("__m.__d").alias("anchor_d"), F.col("__m.__n").alias("anchor_nav"))
