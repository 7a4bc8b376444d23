"""Ranks and exact quantiles of groups that are larger than a task should hold.

Equal values are counted first. Their counts, one row for each value of a group, are dealt by ranges of (group, value) and written;
running sums over the ranges then place every value without a window over a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .scan import running


def _small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """To be broadcast if it has at most so many rows."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def places(rows: DataFrame, value: str, by: list[str], parts: int | None = None) -> DataFrame:
    """(by, value, n, below): each value that is not null with its count and how many rows of its group are smaller."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.repartitionByRange(*([parts] if parts else []), *by, value)
    dealt = written(ranges.withColumn("__part", F.spark_partition_id()), "places")
    out = running(dealt, F.col("n"), "__upto", "sum", by, [value], F.col("__part"))
    return out.select(*by, value, "n", (F.col("__upto") - F.col("n")).alias("below"))


def mean_ranks(rows: DataFrame, value: str, by: list[str], out: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``out``: 1 for the smallest value of the group, ties at the mean of their ranks. Rows whose value or group is null go."""
    ranks = places(rows, value, by, parts).select(*by, value, (F.col("below") + (F.col("n") + 1) / 2).alias(out))
    return rows.join(ranks, [*by, value])


def quantiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """(by, one column for each of ``shares``): exact quantiles, linear between neighbours; nulls do not count."""
    placed = written(places(rows, value, by, parts), "quantiles")
    sizes = placed.groupBy(*by).agg(F.sum("n").alias("__all"))
    found = placed.join(_small(written(sizes, "sizes")), by)
    aggregates = []
    for name, share in shares.items():
        at = (F.col("__all") - 1) * F.lit(float(share))
        holds = lambda i: (F.col("below") <= i) & (i < F.col("below") + F.col("n"))
        low, high = (F.max(F.when(holds(i), F.col(value))) for i in (F.floor(at), F.ceil(at)))
        part = F.max(at - F.floor(at))
        aggregates.append((low + (high - low) * part).alias(name))
    needed = reduce(lambda a, b: a | b, (holds(i((F.col("__all") - 1) * F.lit(float(s)))) for s in shares.values() for i in (F.floor, F.ceil)))
    return found.where(needed).groupBy(*by).agg(*aggregates)


def with_quantiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``rows`` with their group's quantiles."""
    return rows.join(_small(written(quantiles(rows, value, by, shares), "edges")), by)


def correlation(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, rho): rank correlation of two columns, ties at their mean rank, over rows where both are known."""
    both = written(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b), "pairs")
    ranked = mean_ranks(mean_ranks(both, a, by, "__ra"), b, by, "__rb")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("__ra", "__rb").alias("rho"))
