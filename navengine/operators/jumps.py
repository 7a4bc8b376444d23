"""Level jumps: classification, correction of rebases and exclusion of reverted spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import log_return
from .asof import asof_sweep


def classify_jumps(nav: DataFrame, threshold: float = 0.35, before: int = 5, skip: int = 15, after: int = 25, tolerance: float = 0.25) -> DataFrame:
    """Every jump with its ratios to the level before and a label.

    The level before is the median of ``before`` observations; the settled level the
    median of observations skip .. skip + after (both included) after the jump. Without a level before,
    nothing is settled; with too few observations after, the settled ratio is null.
    """
    w = W.partitionBy("fund_id").orderBy("d")
    rows = nav.select("fund_id", "d", "nav").withColumns({"lr": log_return(), "rn": F.row_number().over(w)})
    jumps = rows.where(F.abs("lr") > threshold)
    # Only neighbours of jumps are joined: by fund and position.
    near = F.explode(F.sequence(F.col("rn") - before, F.col("rn") + skip + after))
    wanted = jumps.select("fund_id", F.col("rn").alias("jump"), near.alias("rn"))
    seen = wanted.join(rows.select("fund_id", "rn", "nav"), ["fund_id", "rn"])
    pre, post = F.when(F.col("rn") < F.col("jump"), F.col("nav")), F.when(F.col("rn") >= F.col("jump") + skip, F.col("nav"))
    levels = seen.groupBy("fund_id", "jump").agg(F.median(pre).alias("pre"), F.median(post).alias("post"), F.count(post).alias("n_settled_obs"))
    out = jumps.join(levels, [jumps.fund_id == levels.fund_id, jumps.rn == levels.jump]).drop(levels.fund_id)
    imm, settled = F.try_divide("nav", "pre"), F.try_divide("post", "pre")
    none = F.col("pre").isNull() | (F.col("pre") == 0)
    few = F.col("n_settled_obs") < max(5, after // 3)
    out = out.withColumns({"ratio_immediate": imm, "ratio_settled": F.when(~none & ~few, settled), "n_settled_obs": F.when(none, 0).otherwise(F.col("n_settled_obs"))})
    label = (
        F.when(none, "NO_BASELINE")
        .when(few, "INSUFFICIENT_FORWARD_DATA")
        .when(F.abs(F.col("ratio_settled") - F.col("ratio_immediate")) / F.greatest(F.abs("ratio_immediate"), F.lit(1e-9)) < tolerance, "REBASE")
        .when(F.abs(F.col("ratio_settled") - 1) < tolerance, "REVERT")
        .otherwise("AMBIGUOUS")
    )
    power = F.pow(F.lit(10.0), F.rint(F.log10("ratio_immediate")))
    shape = F.when(F.abs(F.col("ratio_immediate") - power) / power < 0.10, "round").otherwise("not round")
    return out.select("fund_id", "d", "nav", "lr", "ratio_immediate", "ratio_settled", "n_settled_obs", label.alias("label"), F.when(F.col("pre") > 0, shape).alias("rebase_shape"))


def rebase_events(jumps: DataFrame, least_log10: float = 0.5) -> DataFrame:
    """Confirmed changes of the unit: (fund_id, d, factor since that day)."""
    e = jumps.where((F.col("label") == "REBASE") & (F.col("rebase_shape") == "round") & (F.abs(F.log10("ratio_immediate")) > least_log10))
    w = W.partitionBy("fund_id").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    return e.select("fund_id", "d", F.exp(F.sum("lr").over(w)).alias("factor"))


def correct_rebases(nav: DataFrame, events: DataFrame) -> DataFrame:
    """Prices divided by the product of all factors up to their day; as many rows as before."""
    out = asof_sweep(nav.select("fund_id", "d", "nav"), events, "factor")
    return out.select("fund_id", "d", (F.col("nav") / F.coalesce("factor", F.lit(1.0))).alias("nav"))


def drop_reverts(nav: DataFrame, jumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prices without the days of reverted spikes, jumps that a person must look at)."""
    bad = jumps.where("label = 'REVERT'").select("fund_id", "d")
    small = jumps.where((F.col("label") == "REBASE") & (F.col("rebase_shape") == "round") & (F.abs(F.log10("ratio_immediate")) <= 0.5))
    return nav.join(bad, ["fund_id", "d"], "left_anti"), small.join(bad.select("fund_id").distinct(), "fund_id", "left_anti")
