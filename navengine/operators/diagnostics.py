"""Checks of a price store: coverage, freshness, jumps, gaps and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coverage(scheme: DataFrame, nav: DataFrame) -> DataFrame:
    """One row: codes, those not active, prices, codes with prices, first and last date."""
    s = scheme.agg(F.count(F.lit(1)).alias("n_codes"), F.count_if(F.col("status") != "ACTIVE").alias("n_not_active"))
    n = nav.agg(F.count(F.lit(1)).alias("n_nav"), F.count_distinct("amfi_code").alias("n_priced"), F.min("nav_date").alias("first_date"), F.max("nav_date").alias("last_date"))
    return s.crossJoin(F.broadcast(n))  # one row each


def freshness(nav: DataFrame, today: str, current: int = 2, behind: int = 5) -> DataFrame:
    """(last_date, days_behind, verdict)."""
    late = F.datediff(F.lit(today).cast("date"), "last_date")
    verdict = F.when(late <= current, "current").when(late <= behind, "slightly behind").otherwise("stale")
    return nav.agg(F.max("d").alias("last_date")).select("last_date", late.alias("days_behind"), verdict.alias("verdict"))


def common_range(nav: DataFrame, funds: list[str], asof: str | None = None, dead_days: int = 15) -> DataFrame:
    """(start_date, end_date) that all these funds have; no row if there is none, or if with ``asof`` one of them was dead by then."""
    seen = nav.where(F.col("fund_id").isin(funds)).where(F.col("d") <= F.lit(asof).cast("date") if asof else F.lit(True))
    each = seen.groupBy("fund_id").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    each = each if asof is None else each.where(F.datediff(F.lit(asof).cast("date"), "b") <= dead_days)
    out = each.agg(F.max("a").alias("start_date"), F.min("b").alias("end_date"), F.count(F.lit(1)).alias("k"))
    return out.where((F.col("start_date") < F.col("end_date")) & (F.col("k") == len(set(funds)))).drop("k")


def rebased_together(nav: DataFrame, funds: list[str], asof: str | None = None) -> DataFrame:
    """(fund_id, d, rebased): prices over each fund's first one in the range common to all, times 100."""
    window = common_range(nav, funds, asof)  # one row
    rows = nav.where(F.col("fund_id").isin(funds)).join(F.broadcast(window), F.col("d").between(F.col("start_date"), F.col("end_date")))
    first = rows.groupBy("fund_id").agg(F.min_by("nav", "d").alias("first"))
    return rows.join(first, "fund_id").select("fund_id", "d", (F.col("nav") / F.col("first") * 100).alias("rebased"))


def jump_bands(jumps: DataFrame) -> DataFrame:
    """Jumps by size of their log return."""
    x = F.abs("lr")
    band = F.when(x > 2, "over 2").when(x > 1, "1 to 2").when(x > 0.5, "0.5 to 1").otherwise("to 0.5")
    return jumps.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fund_id").alias("funds"))


def handoff_gaps(jumps: DataFrame, nav: DataFrame, mapping: DataFrame, near: int = 7) -> DataFrame:
    """(fund_id, d, lr, gap, bucket): jumps of spliced series with their days from the nearest day on which one of the fund's codes, but for the last, ended."""
    ends = nav.join(mapping.select("scheme_code", "fund_id"), "scheme_code").groupBy("fund_id", "scheme_code").agg(F.max("d").alias("end"))
    w = W.partitionBy("fund_id")
    ends = ends.withColumns({"rn": F.row_number().over(w.orderBy("end", "scheme_code")), "k": F.count(F.lit(1)).over(w)}).where("rn < k").select("fund_id", "end")
    gap = jumps.join(ends, "fund_id", "left").groupBy("fund_id", "d", "lr").agg(F.min(F.abs(F.datediff("d", "end"))).alias("gap"))
    return gap.withColumn("bucket", F.when(F.col("gap").isNull(), "single code").when(F.col("gap") <= near, "near handoff").otherwise("mid series"))


def handoff_buckets(jumps: DataFrame, nav: DataFrame, mapping: DataFrame, near: int = 7) -> DataFrame:
    """Those jumps counted by bucket."""
    return handoff_gaps(jumps, nav, mapping, near).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("lr").alias("avg_lr"))


def worst_handoffs(gaps: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest of them by size; ties by fund and day."""
    return gaps.orderBy(F.desc(F.abs("lr")), "fund_id", "d").limit(k)


def missing_category(scheme: DataFrame, asof: str) -> DataFrame:
    """Codes and those without a category, by plan and age of the last price."""
    age = F.datediff(F.lit(asof).cast("date"), "last_nav_date")
    bucket = F.when(age.isNull(), "never").when(age <= 30, "to 30 days").when(age <= 365, "to a year").otherwise("older")
    out = scheme.groupBy("plan", bucket.alias("age")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category").isNull()).alias("n_missing"))
    return out.withColumn("pct_missing", F.round(100.0 * F.col("n_missing") / F.col("n"), 1))


def conflicting_isins(scheme: DataFrame, field: str) -> DataFrame:
    """Rows of codes that share an isin_growth whose known values of the field differ."""
    known = F.when(F.col(field) != "UNKNOWN", F.col(field))
    bad = scheme.where("isin_growth is not null").groupBy("isin_growth").agg(F.count_distinct(known).alias("k")).where("k > 1").select("isin_growth")
    return scheme.join(bad, "isin_growth", "left_semi")


def rows_by_year(nav: DataFrame) -> DataFrame:
    """Prices, codes, and prices that are missing or not positive, of each year."""
    return nav.groupBy(F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fund_id").alias("funds"), F.count_if(F.col("nav").isNull() | (F.col("nav") <= 0)).alias("n_bad"))


def same_shape(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and funds of both, and whether they agree; the gate before a corrected table is published."""
    count = lambda df, s: df.agg(F.count(F.lit(1)).alias(f"rows_{s}"), F.count_distinct("fund_id").alias(f"funds_{s}"))
    both = count(before, "before").crossJoin(F.broadcast(count(after, "after")))  # one row each
    return both.withColumn("ok", (F.col("rows_before") == F.col("rows_after")) & (F.col("funds_before") == F.col("funds_after")))


def wide_history(nav: DataFrame, funds: list[str]) -> DataFrame:
    """A row for each day, a column for each of these funds, prices to four places."""
    chosen = nav.where(F.col("fund_id").isin(funds))
    return chosen.groupBy("d").pivot("fund_id", funds).agg(F.round(F.max("nav"), 4))


def long_history(nav: DataFrame, funds: list[str]) -> DataFrame:
    """(fund_id, d, nav) of these funds, prices to four places, as ``wide_history`` has them in columns."""
    return nav.where(F.col("fund_id").isin(funds)).groupBy("fund_id", "d").agg(F.round(F.max("nav"), 4).alias("nav"))


def mix(rows: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n): how often each value of the columns occurs, all columns in one pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(cells).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def integrity(nav: DataFrame, snapshot: DataFrame, scheme: DataFrame, today: str) -> DataFrame:
    """One row: prices that are not positive, prices after ``today``, snapshot rows of unknown codes, ISINs whose codes have several known plans, and ISINs of several codes."""
    prices = nav.agg(F.count_if(F.col("nav") <= 0).alias("n_not_positive"), F.count_if(F.col("nav_date") > F.lit(today).cast("date")).alias("n_future"))
    orphans = snapshot.join(scheme.select("amfi_code"), "amfi_code", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
    isin = F.nullif(F.trim("isin_growth"), F.lit("-"))
    by = scheme.where(isin.isNotNull()).groupBy(isin.alias("isin")).agg(F.count_distinct(F.when(F.col("plan") != "UNKNOWN", F.col("plan"))).alias("plans"), F.count_distinct("amfi_code").alias("codes"))
    isins = by.agg(F.count_if(F.col("plans") > 1).alias("n_conflicting_isins"), F.count_if(F.col("codes") > 1).alias("n_shared_isins"))
    return prices.crossJoin(F.broadcast(orphans)).crossJoin(F.broadcast(isins))  # one row each


def log_summary(log: DataFrame) -> DataFrame:
    """(source, runs, n_failed, n_rows, n_added, last_at) of a log (source, ok, n_rows, n_added, at)."""
    return log.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum("n_rows").alias("n_rows"), F.sum("n_added").alias("n_added"), F.max("at").alias("last_at"))


def uncategorised(scheme: DataFrame, since: str, has: str = "") -> DataFrame:
    """(scheme_name, amfi_code, last_nav_date, has_sibling): active codes without a category whose name holds ``has`` (any case) and whose last price is not before ``since``, by name."""
    isin = F.nullif(F.trim("isin_growth"), F.lit("-"))
    known = scheme.where("category is not null").where(isin.isNotNull()).select(isin.alias("__isin")).distinct().withColumn("__known", F.lit(True))
    rows = scheme.where("category is null").where((F.col("last_nav_date") >= F.lit(since).cast("date")) & F.lower("scheme_name").contains(has.lower()))
    out = rows.join(known, isin == F.col("__isin"), "left").select("scheme_name", "amfi_code", "last_nav_date", F.coalesce("__known", F.lit(False)).alias("has_sibling"))
    return out.orderBy("scheme_name", "amfi_code")


def worst_days(jumps: DataFrame, k: int) -> DataFrame:
    """(fund_id, d, lr): the ``k`` largest jumps by size, a fund as often as it has them; ties by fund and day."""
    return jumps.select("fund_id", "d", "lr").distinct().orderBy(F.desc(F.abs("lr")), "fund_id", "d").limit(k)
