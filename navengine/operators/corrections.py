"""A ledger of corrections: which prices go, which jumps resolve themselves, and which a person must look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEDGER = "fund_id string, d date, bad_d date, origin string, state string, note string"


def trivial(jumps: DataFrame, most_log10: float = 0.5) -> Column:
    """A rebase by a round factor whose power of ten rounds to one: it may be a bad price on the day before."""
    size = F.abs(F.log10("ratio_immediate"))
    return F.coalesce((F.col("label") == "REBASE") & F.col("rebase_shape").startswith("round") & (F.col("ratio_immediate") > 0) & (size <= most_log10), F.lit(False))


def ledger(jumps: DataFrame, allowed: DataFrame) -> DataFrame:
    """(fund_id, d, bad_d, origin, state, note): an entry for each jump that asks for one.

    A reverted spike (origin revert) is bad itself: state "resolved". A trivial rebase (origin rebase) of a fund with a reverted spike
    is resolved by it, with no bad day of its own. Of the others, those whose fund is on the allow-list (fund_id, bad_date, note) are "allowed", and
    the day that the list names goes, which is not the day of the jump; the rest is "to review" and takes nothing away. A fund that the list names several times
    loses all those days; a fund on it without such a jump loses none.
    """
    j = jumps.select("fund_id", "d", "label", trivial(jumps).alias("trivial"))
    revert = j.where("label = 'REVERT'").select("fund_id", "d", F.col("d").alias("bad_d"), F.lit("revert").alias("origin"), F.lit("resolved").alias("state"), F.lit(None).cast("string").alias("note"))
    spiked = revert.select("fund_id").distinct().withColumn("spiked", F.lit(True))
    rest = j.where("trivial").join(spiked, "fund_id", "left").join(allowed.select("fund_id", F.col("bad_date").alias("bad_d"), "note").distinct(), "fund_id", "left")
    own = F.col("spiked").isNull()
    state = F.when(~own, "resolved").when(F.col("bad_d").isNotNull(), "allowed").otherwise("to review")
    keep = lambda c: F.when(own, F.col(c)).alias(c)
    rest = rest.select("fund_id", "d", keep("bad_d"), F.lit("rebase").alias("origin"), state.alias("state"), keep("note")).distinct()
    return revert.unionByName(rest)


def apply(nav: DataFrame, entries: DataFrame) -> DataFrame:
    """``nav`` without the bad days of entries that are resolved or allowed."""
    bad = entries.where("state in ('resolved', 'allowed') and bad_d is not null").select("fund_id", F.col("bad_d").alias("d")).distinct()
    return nav.join(bad, ["fund_id", "d"], "left_anti")


def taken(nav: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of ``nav`` that ``apply`` takes away; kept beside the corrected table, they undo it."""
    bad = entries.where("state in ('resolved', 'allowed') and bad_d is not null").select("fund_id", F.col("bad_d").alias("d")).distinct()
    return nav.join(bad, ["fund_id", "d"], "left_semi")


def undo(nav: DataFrame, gone: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """``nav`` with what was taken put back: everything, or the days of these entries. A day that is there already stays as it is."""
    back = gone if entries is None else gone.join(entries.select("fund_id", F.col("bad_d").alias("d")).distinct(), ["fund_id", "d"], "left_semi")
    return nav.unionByName(back.join(nav.select("fund_id", "d"), ["fund_id", "d"], "left_anti"))


def review(entries: DataFrame) -> DataFrame:
    return entries.where("state = 'to review'")


def summary(entries: DataFrame) -> DataFrame:
    """Entries, funds and days that go, by origin and state."""
    return entries.groupBy("origin", "state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fund_id").alias("funds"), F.count_distinct("fund_id", "bad_d").alias("n_bad_days"))
