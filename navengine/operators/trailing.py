"""Trailing windows, peers, survivorship, rolling returns and portfolios, for all funds at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import DAYS_PER_YEAR, annual_vol, cagr, horizon_days, sharpe
from ..sources.shared import written
from . import ranks
from .asof import last_at_or_before, nearest_by_row, nearest_within

NEAREST_DAYS = 45
DEATH_DAYS = 15


def trailing(nav: DataFrame, asof: str, years: int) -> DataFrame:
    """Each fund with a price up to the date and one near the horizon's start: return, growth a year, and whether it is dead (over 15 days stale)."""
    return trailing_all(nav, asof, (years,)).drop("horizon_y")


def trailing_all(nav: DataFrame, asof: str, horizons: tuple[int, ...]) -> DataFrame:
    """The same for several horizons (horizon_y) at once."""
    day = F.lit(asof).cast("date")
    targets = F.explode(F.array(*(F.struct(F.lit(y).alias("horizon_y"), F.date_sub(day, horizon_days(y)).alias("target")) for y in horizons)))
    last = last_at_or_before(nav, asof).select("*", targets.alias("__t")).select("fund_id", "last_d", "last_nav", "__t.horizon_y", "__t.target")
    both = nearest_within(last, nav, "target", NEAREST_DAYS).where("anchor_nav > 0")
    growth = F.col("last_nav") / F.col("anchor_nav")
    stale = F.datediff(day, "last_d")
    return both.select("horizon_y", "fund_id", "last_d", "last_nav", "anchor_d", "anchor_nav", stale.alias("stale_days"), (stale > DEATH_DAYS).alias("is_dead"), (growth - 1).alias("window_return"), cagr(growth, F.datediff("last_d", "anchor_d")).alias("cagr"))


def risk(nav: DataFrame, ends: DataFrame) -> DataFrame:
    """Volatility, drawdown (negative, anchor included) and Sharpe ratio of each fund between its anchor and last day."""
    return risk_all(nav, ends.withColumn("horizon_y", F.lit(0))).select("fund_id", "ann_vol", "max_dd", "sharpe")


def risk_all(nav: DataFrame, ends: DataFrame) -> DataFrame:
    """(fund_id, horizon_y, ann_vol, n_obs, max_dd, sharpe) for every fund and horizon of ``ends``.

    Volatility and its count take the log returns after the anchor's day, so the first one is from the day after it; the
    drawdown is negative and has the anchor's day in it.
    """
    n = nav.join(ends.select("fund_id", "horizon_y", "anchor_d", "last_d", "cagr"), "fund_id").where("d between anchor_d and last_d")
    w = W.partitionBy("fund_id", "horizon_y").orderBy("d")
    n = n.withColumns({"top": F.max("nav").over(w.rowsBetween(W.unboundedPreceding, 0)), "lr": F.ln(F.col("nav") / F.lag("nav").over(w)), "__was": F.lag("d").over(w)})
    n = n.withColumn("lr", F.when(F.col("__was") > F.col("anchor_d"), F.col("lr")))
    out = n.groupBy("fund_id", "horizon_y").agg(annual_vol(F.col("lr")).alias("ann_vol"), F.count("lr").alias("n_obs"), F.min(F.col("nav") / F.col("top") - 1).alias("max_dd"), F.first("cagr").alias("__c"))
    return out.select("fund_id", "horizon_y", "ann_vol", "n_obs", "max_dd", sharpe(F.col("__c"), F.col("ann_vol")).alias("sharpe"))


def canonical(fund_map: DataFrame, category_map: DataFrame) -> DataFrame:
    """(fund_id, category): each fund once under the canonical form of its category (raw_category, canonical_category); several, if its names were in several."""
    of = category_map.select(F.col("raw_category").alias("category"), "canonical_category")
    return fund_map.join(of, "category").select("fund_id", F.col("canonical_category").alias("category")).distinct()


def category_snapshot(nav: DataFrame, funds: DataFrame, asof: str, horizons: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(living peers, counts) of every category of ``funds`` (fund_id, category) and horizon.

    Living peers: category, horizon_y, fund_id, window_return, cagr, actual_years, ann_vol, n_obs, sharpe, max_dd. Counts: category, horizon_y,
    n_considered (funds with a price and an anchor), n_dead; the dead are in no average and no rank.
    """
    rows = funds.select("fund_id", "category").distinct().join(trailing_all(nav, asof, horizons), "fund_id")
    counts = rows.groupBy("category", "horizon_y").agg(F.count(F.lit(1)).alias("n_considered"), F.count_if("is_dead").alias("n_dead"))
    alive = rows.where("not is_dead")
    risks = risk_all(nav, alive.select("fund_id", "horizon_y", "anchor_d", "last_d", "cagr").distinct())
    alive = alive.join(risks, ["fund_id", "horizon_y"], "left").withColumn("actual_years", F.datediff("last_d", "anchor_d") / DAYS_PER_YEAR)
    return alive.select("category", "horizon_y", "fund_id", "window_return", "cagr", "actual_years", "ann_vol", "n_obs", "sharpe", "max_dd"), counts


def peer_rank(rows: DataFrame, metric: str, group: str) -> DataFrame:
    """rank (1 + better peers), n_peers and percentile within the group."""
    w = W.partitionBy(group)
    rank, n = F.rank().over(w.orderBy(F.desc(metric))), F.count(F.lit(1)).over(w)
    out = rows.where(F.col(metric).isNotNull()).withColumns({"rank": rank, "n_peers": n})
    return out.withColumn("percentile", F.when(F.col("n_peers") <= 1, 100.0).otherwise(F.round(100.0 * (F.col("n_peers") - F.col("rank")) / (F.col("n_peers") - 1), 1)))


def survivorship(rows: DataFrame, group: str, least: int = 5) -> DataFrame:
    """Funds considered and dead in each group, of all groups in one pass."""
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_considered"), F.count_if("is_dead").alias("n_dead"))
    return out.where(F.col("n_considered") >= least).withColumn("attrition_pct", F.round(100.0 * F.col("n_dead") / F.col("n_considered"), 1))


def rolling_returns(nav: DataFrame, years: int, step: int = 5) -> DataFrame:
    """From every ``step``-th observation of a fund the growth a year to the price nearest to the horizon's end."""
    return rolling_all(nav, (years,), step).drop("horizon_y")


def rolling_all(nav: DataFrame, horizons: tuple[int, ...] = (1, 3, 5), step: int = 5) -> DataFrame:
    """The same for several horizons (horizon_y) at once: a price meets the starts of all of them in one join."""
    w = W.partitionBy("fund_id").orderBy("d")
    starts = nav.select("fund_id", "d", "nav", F.row_number().over(w).alias("rn")).where((F.col("rn") - 1) % step == 0)
    ends = F.explode(F.array(*(F.struct(F.lit(y).alias("horizon_y"), F.date_add("d", horizon_days(y)).alias("target")) for y in horizons))).alias("__e")
    starts = starts.select("fund_id", F.struct(F.col("d").alias("start_d"), F.col("nav").alias("start_nav")).alias("start"), ends).select("fund_id", "start", "__e.horizon_y", "__e.target")
    near = nearest_by_row(starts, nav, "target", NEAREST_DAYS, ["fund_id", "horizon_y", "start", "target"])
    out = near.select("fund_id", "horizon_y", "start.start_d", "start.start_nav", "anchor_d", "anchor_nav").where("anchor_d > start_d")
    return out.select("fund_id", "horizon_y", "start_d", F.col("anchor_d").alias("end_d"), cagr(F.col("anchor_nav") / F.col("start_nav"), F.datediff("anchor_d", "start_d")).alias("cagr"))


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, median, tenths, extremes and the share below 0."""
    q = lambda p: F.percentile(value, F.lit(p))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), q(0.5).alias("median"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.min(value).alias("worst"), F.max(value).alias("best"), (100.0 * F.count_if(F.col(value) < 0) / F.count(value)).alias("pct_negative"))


def common_returns(nav: DataFrame, funds: list[str]) -> DataFrame:
    """(d, fund_id, r): simple returns on the days that all these funds have."""
    w = W.partitionBy("fund_id").orderBy("d")
    r = nav.where(F.col("fund_id").isin(funds)).select("fund_id", "d", (F.col("nav") / F.lag("nav").over(w) - 1).alias("r")).where("r is not null")
    days = r.groupBy("d").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(set(funds))).select("d")
    return r.join(days, "d", "left_semi").select("d", "fund_id", "r")


def pair_matrix(returns: DataFrame) -> DataFrame:
    """Correlation and covariance of log growth for each two funds, in long form."""
    lr = returns.select("d", "fund_id", F.log1p("r").alias("lr"))
    other = lr.select("d", F.col("fund_id").alias("fund_b"), F.col("lr").alias("lb"))
    return lr.join(other, "d").groupBy(F.col("fund_id").alias("fund_a"), "fund_b").agg(F.corr("lr", "lb").alias("corr"), F.covar_samp("lr", "lb").alias("cov"))


def portfolio_path(returns: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(d, r, nav): a portfolio brought back to its weights every day."""
    w: Column = F.lit(0.0)
    for fund, x in weights.items():
        w = F.when(F.col("fund_id") == fund, x).otherwise(w)
    daily = returns.groupBy("d").agg(F.sum(F.col("r") * w).alias("r"))
    # One row for each common day: a few thousand, however many funds there are.
    return daily.withColumn("nav", F.exp(F.sum(F.log1p("r")).over(W.orderBy("d").rowsBetween(W.unboundedPreceding, 0))))


def persistence_pairs(panel: DataFrame, metric: str, least_coverage: float = 0.9) -> DataFrame:
    """A fund's metric in a window and in the next of the same phase, of windows it survived with enough coverage."""
    good = panel.where((F.col("coverage_frac") >= least_coverage) & F.col("survived") & F.col(metric).isNotNull())
    w = W.partitionBy("fund_id", "horizon_y", "phase").orderBy("fy_start")  # windows of a phase follow each other
    both = good.select("fund_id", "horizon_y", "phase", F.col("fy_start").alias("fy"), F.col(metric).alias("formation"), F.lead(metric).over(w).alias("holding"), F.lead("fy_start").over(w).alias("__next"))
    return both.where(F.col("__next") == F.col("fy") + F.col("horizon_y")).drop("__next")


def quartiles(pairs: DataFrame) -> DataFrame:
    """Quartile of either metric in its year by interpolated edges; years whose edges coincide are left out."""
    out, edges = written(pairs, "pairs"), {f"__e{i}": i / 4 for i in range(5)}
    for value, name in (("formation", "fq"), ("holding", "hq")):
        out = ranks.with_quantiles(out, value, ["horizon_y", "fy"], edges)
        q = F.lit(4)
        for i in (3, 2, 1):
            q = F.when(F.col(value) <= F.col(f"__e{i}"), i).otherwise(q)
        out = out.withColumn(name, F.when(F.size(F.array_distinct(F.array(*edges))) == 5, q)).drop(*edges)
    return out.where("fq is not null and hq is not null")


def transitions(pairs: DataFrame) -> DataFrame:
    """Counts and row shares of quartile moves."""
    n = quartiles(pairs).groupBy("horizon_y", "fq", "hq").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("horizon_y", "fq")))


def repeat_winners(pairs: DataFrame, least: int = 10) -> DataFrame:
    """In each year the share of winners (at or above the median) that win again, and its Z value."""
    by, pairs = ["horizon_y", "fy"], written(pairs, "pairs")
    p = ranks.with_quantiles(ranks.with_quantiles(pairs, "formation", by, {"__mf": 0.5}), "holding", by, {"__mh": 0.5}).where("formation >= __mf")
    out = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("holding") >= F.col("__mh")).alias("repeats")).where(F.col("n") >= least)
    rate = F.col("repeats") / F.col("n")
    return out.withColumns({"rate": rate, "z": (rate - 0.5) / F.sqrt(0.25 / F.col("n"))})


def spearman(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Rank correlation in each year, ties at their mean rank."""
    return ranks.correlation(pairs, "formation", "holding", ["horizon_y", "fy"]).where(F.col("n") >= least)


def portfolio_summary(returns: DataFrame, weights: dict[str, float], least: int = 20) -> DataFrame:
    """One row: weighted and portfolio volatility, their ratio, drawdown (negative), growth a year and Sharpe ratio; none with fewer than ``least`` common days."""
    share = F.coalesce(*(F.when(F.col("fund_id") == f, F.lit(float(x))) for f, x in weights.items()), F.lit(0.0))
    each = returns.groupBy("fund_id").agg(annual_vol(F.log1p("r")).alias("vol")).agg(F.sum(F.col("vol") * share).alias("weighted_vol"))
    path = portfolio_path(returns, weights)
    top = F.max("nav").over(W.orderBy("d").rowsBetween(W.unboundedPreceding, 0))  # one row for each common day
    whole = path.withColumn("fall", F.col("nav") / top - 1).agg(F.count(F.lit(1)).alias("n_obs"), annual_vol(F.log1p("r")).alias("portfolio_vol"), F.min("fall").alias("max_dd"), cagr(F.max_by("nav", "d"), F.datediff(F.max("d"), F.min("d"))).alias("cagr"))
    out = whole.where(F.col("n_obs") >= least).crossJoin(F.broadcast(each))  # one row each
    return out.withColumns({"diversification_ratio": F.when(F.col("portfolio_vol") > 1e-6, F.col("weighted_vol") / F.col("portfolio_vol")), "sharpe": sharpe(F.col("cagr"), F.col("portfolio_vol"))})


def risk_contribution(returns: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(fund_id, contribution): each fund's share of the variance of simple returns; the shares add to 1."""
    share = lambda c: F.coalesce(*(F.when(F.col(c) == f, F.lit(float(x))) for f, x in weights.items()), F.lit(0.0))
    other = returns.select("d", F.col("fund_id").alias("fund_b"), F.col("r").alias("rb"))
    cov = returns.join(other, "d").groupBy("fund_id", "fund_b").agg(F.covar_samp("r", "rb").alias("cov"))
    own = cov.groupBy("fund_id").agg(F.sum(share("fund_id") * share("fund_b") * F.col("cov")).alias("part"))
    total = own.agg(F.sum("part").alias("__total"))
    return own.crossJoin(F.broadcast(total)).select("fund_id", F.when(F.col("__total") > 0, F.col("part") / F.col("__total")).alias("contribution"))


def cramers_v(counts: DataFrame) -> DataFrame:
    """(horizon_y, n, chi2, v) of the counts (fq, hq, n) of a horizon; v is null if either side has one value only."""
    by = W.partitionBy("horizon_y")
    t = counts.select("horizon_y", "fq", "hq", "n", F.sum("n").over(by.partitionBy("horizon_y", "fq")).alias("r"), F.sum("n").over(by.partitionBy("horizon_y", "hq")).alias("c"))
    out = t.groupBy("horizon_y").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"), F.least(F.count_distinct("fq"), F.count_distinct("hq")).alias("k"))
    chi2 = F.col("n") * (F.col("s") - 1)
    return out.select("horizon_y", "n", chi2.alias("chi2"), F.when(F.col("k") > 1, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("n") * (F.col("k") - 1)))).alias("v"))


def snapshot(nav: DataFrame, funds: DataFrame, asof: str, horizons: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """A row for each fund (fund_id, category) and horizon: value (return at one year, else growth a year), mean and rank among its live peers.

    Funds without a live value are labelled: Died, or Too new.
    """
    last = last_at_or_before(nav, asof).select("fund_id", (F.datediff(F.lit(asof).cast("date"), "last_d") > DEATH_DAYS).alias("__dead"))
    base = funds.select("fund_id", "category").join(last, "fund_id", "left")
    w = W.partitionBy("category", "horizon_y")
    value = F.when(F.col("horizon_y") == 1, F.col("window_return")).otherwise(F.col("cagr"))
    values = trailing_all(nav, asof, horizons).where("not is_dead").select("fund_id", "horizon_y", value.alias("value"))
    every = base.withColumn("horizon_y", F.explode(F.array(*map(F.lit, horizons))))
    rows = every.join(values, ["fund_id", "horizon_y"], "left").withColumns({"cat_avg": F.avg("value").over(w), "n_peers": F.count("value").over(w), "rank": F.rank().over(w.orderBy(F.desc_nulls_last("value")))})
    rows = rows.withColumns({"rank": F.when(F.col("value").isNotNull(), F.col("rank")), "label": F.when(F.col("value").isNull(), F.when(F.coalesce("__dead", F.lit(True)), "Died").otherwise("Too new"))})
    return rows.select("fund_id", "category", "horizon_y", "value", "cat_avg", "rank", "n_peers", "label")
