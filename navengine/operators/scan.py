"""Running values over series that are longer than a task should hold.

A series is cut into segments in its order. The total of each segment is a small row; a window over these rows alone gives
what comes before each segment, and that row is put first in its segment, so that the window over the prices themselves
is partitioned by series and segment. No task holds a whole series, and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HOW = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}


def running(rows: DataFrame, value: Column, out: str, how: str, key: list[str], order: list[str], segment: Column, inclusive: bool = True) -> DataFrame:
    """``rows`` with ``out``: the max, min, sum or last known ``value`` of the rows up to each (before each, if not ``inclusive``).

    Rows of a key come by ``segment``, and in a segment by ``order``; a segment must lie wholly before the next one. Null
    values are passed over, a null key is a series of its own, and an empty table stays empty.
    """
    f = _HOW[how]
    base = rows.withColumns({"__v": value, "__s": segment})
    known = F.when(F.col("__v").isNotNull(), F.struct(*order))
    total = F.max_by("__v", known) if how == "last" else f("__v")
    per = base.groupBy(*key, "__s").agg(total.alias("__t"))
    before = W.partitionBy(*key).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    first = per.select(*key, "__s", f("__t").over(before).alias("__v"), F.lit(0).alias("__side"))
    both = base.withColumn("__side", F.lit(1)).unionByName(first, allowMissingColumns=True)
    w = W.partitionBy(*key, "__s").orderBy("__side", *order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    return both.withColumn(out, f("__v").over(w)).where("__side = 1").drop("__side", "__v", "__s")


def of_days(date: str = "d", days: int = 1024) -> Column:
    """Segments of so many days."""
    return F.floor(F.unix_date(date) / days)


def log_returns(nav: DataFrame, key: str = "fund_id", days: int = 1024) -> DataFrame:
    """``nav`` with lr, the log return since the row before; null at a series' start."""
    out = running(nav, F.col("nav"), "__was", "last", [key], ["d"], of_days(days=days), inclusive=False)
    return out.withColumn("lr", F.ln(F.col("nav") / F.col("__was"))).drop("__was")


def drawdowns(nav: DataFrame, key: str = "fund_id", days: int = 1024) -> DataFrame:
    """``nav`` with top, the highest price so far, and fall, the price over it less 1."""
    out = running(nav, F.col("nav"), "top", "max", [key], ["d"], of_days(days=days))
    return out.withColumn("fall", F.col("nav") / F.col("top") - 1)


def growth_index(returns: DataFrame, key: str = "fund_id", days: int = 1024) -> DataFrame:
    """``returns`` (d, lr) with index: the running product of exp(lr), null returns counting as none."""
    out = running(returns, F.coalesce("lr", F.lit(0.0)), "__sum", "sum", [key], ["d"], of_days(days=days))
    return out.withColumn("index", F.exp("__sum")).drop("__sum")
