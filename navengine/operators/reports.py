"""Tables for readers: one-pagers, category lists, tests with p values, and diagnoses of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, pvalues, series
from ..sources.shared import written
from . import ranks, trailing


def normalised_weights(funds: list[str], weights: list[float] | None = None) -> dict[str, float]:
    """Weights that sum to 1, from percents or fractions; equal ones by default."""
    given = weights if weights is not None else [1.0] * len(funds)
    if len(given) != len(funds) or not funds:
        raise ValueError(f"{len(given)} weights for {len(funds)} funds")
    if min(given) < 0 or sum(given) <= 0:
        raise ValueError("weights must not be negative, and not all zero")
    return {f: w / sum(given) for f, w in zip(funds, given, strict=True)}


def one_pager(nav: DataFrame, funds: DataFrame, asof: str, horizons: tuple[int, ...] = (1, 3, 5, 10), chosen: list[str] | None = None, least_obs: int = 20) -> DataFrame:
    """Each chosen fund (all by default) against the living peers of its category (fund_id, category), a row for each horizon.

    value is the return at one year and the growth a year beyond; it and the Sharpe ratio come with rank (1 + better peers),
    percentile and the category's mean. A fund without an anchor has the state "insufficient history" and a dead one "died <year>", with no figures.
    """
    wide = snapshot_ranks(nav, funds, asof, horizons)
    every = funds.select("fund_id", "category").distinct().withColumn("horizon_y", F.explode(F.array(*map(F.lit, horizons))))
    every = every if chosen is None else every.where(F.col("fund_id").isin(chosen))
    window = trailing.trailing_all(nav, asof, horizons).select("fund_id", "horizon_y", "is_dead", F.year("last_d").alias("__year"))
    rows = every.join(window, ["fund_id", "horizon_y"], "left").join(wide, ["category", "fund_id", "horizon_y"], "left")
    state = F.when(F.col("is_dead").isNull(), "insufficient history").when(F.col("is_dead"), F.concat(F.lit("died "), "__year")).otherwise("alive")
    note = F.concat_ws("; ", F.when(F.col("n_dead") > 0, F.concat("n_dead", F.lit(" of "), "n_considered", F.lit(" peers had died"))), F.when(F.col("n_obs") < least_obs, F.concat(F.lit("only "), "n_obs", F.lit(" returns"))))
    return rows.withColumns({"state": state, "notes": F.when(state == "alive", note)}).drop("is_dead", "__year")


def snapshot_ranks(nav: DataFrame, funds: DataFrame, asof: str, horizons: tuple[int, ...]) -> DataFrame:
    """The living peers of each category and horizon with value, rank, n_peers, percentile and category means, and the same of the Sharpe ratio."""
    alive, counts = trailing.category_snapshot(nav, funds, asof, horizons)
    by = ["category", "horizon_y"]
    alive = written(alive.withColumn("value", F.when(F.col("horizon_y") <= 1, F.col("window_return")).otherwise(F.col("cagr"))), "peers")
    means = alive.groupBy(*by).agg(F.count(F.lit(1)).alias("n_peers"), F.avg("value").alias("cat_avg"), F.avg("ann_vol").alias("cat_vol"), F.avg("sharpe").alias("cat_sharpe"))
    out = alive.join(means, by).join(counts, by)
    for metric, name in (("value", "rank"), ("sharpe", "sharpe_rank")):
        place = ranks.places(alive, metric, by).select(*by, metric, "below", "n")
        known = place.groupBy(*by).agg(F.sum("n").alias("__all"))
        better = place.join(known, by).select(*by, metric, (F.col("__all") - F.col("below") - F.col("n") + 1).alias(name))
        out = out.join(better, [*by, metric], "left")
    percentile = lambda r: F.when(F.col(r).isNotNull(), F.when(F.col("n_peers") <= 1, 100.0).otherwise(F.round(100.0 * (F.col("n_peers") - F.col(r)) / (F.col("n_peers") - 1), 1)))
    out = out.withColumns({"percentile": percentile("rank"), "sharpe_percentile": percentile("sharpe_rank")})
    return out.select(
        *by, "fund_id", "value", "cat_avg", "rank", "n_peers", "percentile", "ann_vol", "n_obs", "cat_vol", "sharpe", "cat_sharpe", "sharpe_rank", "sharpe_percentile", "max_dd", "n_considered", "n_dead",
    )


def as_percent(value: Column) -> Column:
    """+12.34%, or n/a for null."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%+.2f%%", value * 100))


def as_ratio(value: Column) -> Column:
    """+1.23, or n/a for null."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%+.2f", value))


def lines_of(one_pagers: DataFrame) -> DataFrame:
    """(fund_id, horizon_y, line): a one-pager's rows as text: value, category mean, volatility, rank and percentile, or the state."""
    figures = F.concat_ws(" | ", as_percent(F.col("value")), as_percent(F.col("cat_avg")), as_percent(F.col("ann_vol")), F.concat("rank", F.lit("/"), "n_peers"), F.bround("percentile", 0).cast("int").cast("string"))
    return one_pagers.select("fund_id", "horizon_y", F.when(F.col("state") == "alive", figures).otherwise(F.col("state")).alias("line"))


def browse(peers: DataFrame, names: DataFrame) -> DataFrame:
    """Living funds of each category, best first: position, percentile, name, and the share of the category's funds that died."""
    alive = trailing.peer_rank(peers.where("not is_dead").select("fund_id", "category", "cagr"), "cagr", "category")
    lost = peers.groupBy("category").agg(F.round(100.0 * F.count_if("is_dead") / F.count(F.lit(1)), 1).alias("attrition_pct"))
    place = F.row_number().over(W.partitionBy("category").orderBy(F.desc("cagr"), "fund_id"))
    return alive.withColumn("position", place).join(lost, "category").join(names, "fund_id", "left").select("category", "position", "fund_id", "name", "cagr", "percentile", "attrition_pct")


def transition_test(transitions: DataFrame) -> DataFrame:
    """Chi-square of each horizon's table of quartiles against independence: chi2, dof, p.

    Tables of two by two are corrected for continuity: all four cells are equally far from what is expected, and come nearer by a half.
    """
    w = W.partitionBy("horizon_y")
    cells = transitions.withColumns({"r": F.sum("n").over(w.partitionBy("horizon_y", "fq")), "c": F.sum("n").over(w.partitionBy("horizon_y", "hq")), "all": F.sum("n").over(w)})
    out = cells.groupBy("horizon_y").agg(
        (F.sum("n") * (F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))) - 1)).alias("chi2"), ((F.count_distinct("fq") - 1) * (F.count_distinct("hq") - 1)).alias("dof"),
        F.max(F.abs(F.col("n") - F.col("r") * F.col("c") / F.col("all"))).alias("off"),
    )
    nearer = F.when((F.col("dof") == 1) & (F.col("off") > 0), F.pow(F.greatest(F.col("off") - 0.5, F.lit(0.0)) / F.col("off"), 2)).otherwise(1.0)
    return out.withColumn("chi2", F.col("chi2") * nearer).drop("off").withColumn("p", pvalues.chi_square_p("chi2", "dof"))


def rank_correlation_test(spearman: DataFrame) -> DataFrame:
    """``spearman`` with the two-sided p value of rho."""
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return spearman.withColumn("p", F.when(F.abs("rho") >= 1, 0.0).otherwise(pvalues.student_p(t, F.col("n") - 2)))


def without_isin(scheme: DataFrame, asof: str) -> DataFrame:
    """Codes, and those with no ISIN at all, by status and whether the last price is within a year."""
    age = F.datediff(F.lit(asof).cast("date"), "last_nav_date")
    era = F.when(age.isNull(), "never").when(age <= 365, "recent").otherwise("older")
    isin = F.coalesce(F.nullif("isin_growth", F.lit("-")), F.nullif("isin_div", F.lit("-")))
    return scheme.groupBy("status", era.alias("era")).agg(F.count(F.lit(1)).alias("n"), F.count_if(isin.isNull()).alias("n_without"))


def survivor_mix(panel: DataFrame, funds: DataFrame, fy: int) -> DataFrame:
    """Categories of the funds that survived a window starting in ``fy`` and of those that did not."""
    got = panel.where(F.col("fy_start") == fy).join(funds, "fund_id").groupBy("horizon_y", "survived", "category").agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("horizon_y", "survived")))


def trajectory(nav: DataFrame, funds: list[str] | None, start: str, end: str) -> DataFrame:
    """Prices and log returns of these funds (None: all) between two dates; the first return looks back before ``start``."""
    return (nav if funds is None else nav.where(F.col("fund_id").isin(funds))).select("fund_id", "d", "nav", series.log_return().alias("lr")).where(F.col("d").between(start, end))


def category_fill(scheme: DataFrame, *by: str) -> DataFrame:
    """Codes, those with a category, and their share, by any columns."""
    return scheme.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("category").alias("n_filled"), F.round(100.0 * F.count("category") / F.count(F.lit(1)), 1).alias("pct_filled"))


def category_gaps(scheme: DataFrame, since: str) -> DataFrame:
    """Codes without a category, by era and whether a code of the same ISIN has one."""
    isin = F.nullif("isin_growth", F.lit("-"))
    known = scheme.where("category is not null").select(isin.alias("isin")).where("isin is not null").distinct().withColumn("sibling", F.lit(True))
    gaps = scheme.where("category is null").withColumn("isin", isin).join(known, "isin", "left")
    era = F.when(F.col("last_nav_date") >= F.lit(since).cast("date"), "recent").otherwise("older or never")
    return gaps.groupBy(era.alias("era"), F.coalesce("sibling", F.lit(False)).alias("has_sibling")).agg(F.count(F.lit(1)).alias("n"))


def category_worklist(scheme: DataFrame, only_direct_growth: bool = False, limit: int | None = None) -> DataFrame:
    """Codes without a category, in order."""
    out = scheme.where("category is null").where("plan = 'DIRECT' and option = 'GROWTH'" if only_direct_growth else "true").select("amfi_code", "scheme_name").orderBy("amfi_code")
    return out if limit is None else out.limit(limit)


def rederived_option(scheme: DataFrame) -> DataFrame:
    """``scheme`` with option derived from the name again and ``was``, the old one."""
    return scheme.withColumn("was", F.col("option")).withColumn("option", classify.option_of(F.col("scheme_name")))


def name_hits(scheme: DataFrame, terms: list[str]) -> DataFrame:
    """How many names have each of these substrings (any case), and the first of them."""
    found = F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower("scheme_name"), t))
    return scheme.select("scheme_name", F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("scheme_name").alias("first_name"))


def without_keys(nav: DataFrame, keys: DataFrame) -> DataFrame:
    """``nav`` without the rows whose (fund_id, d) is among the keys."""
    return nav.join(keys.select("fund_id", "d"), ["fund_id", "d"], "left_anti")
