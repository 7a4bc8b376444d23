"""Choosing funds: by name, identifier, category, plan and option, and what a name says about closed ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.classify import has_words, is_closed_end
from . import ranks


def latest_names(fund_map: DataFrame) -> DataFrame:
    """One row for each fund: name and category of its highest scheme code."""
    return fund_map.groupBy("fund_id").agg(F.max_by(F.struct("scheme_name", "category"), "scheme_code").alias("__m")).select("fund_id", "__m.scheme_name", "__m.category")


def closed_end_funds(fund_map: DataFrame) -> DataFrame:
    """fund_id, scheme_name, closed_end: by the latest name of each fund."""
    return latest_names(fund_map).select("fund_id", "scheme_name", is_closed_end(F.col("scheme_name")).alias("closed_end"))


def open_ended(rows: DataFrame, fund_map: DataFrame) -> DataFrame:
    """``rows`` without the funds whose latest name speaks of a closed end."""
    return rows.join(closed_end_funds(fund_map).where("closed_end").select("fund_id"), "fund_id", "left_anti")


def in_categories(category: Column, parts: list[str]) -> Column:
    """Whether any of the parts stands in the category, in any case; all categories if there are no parts."""
    tests = [F.lower(category).contains(p.strip().lower()) for p in parts]
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(True)


def only(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows with the wanted values; columns for which None is wanted are not looked at."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[1] is not None else df, wanted.items(), rows)


def between(rows: DataFrame, date: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows from ``first`` to ``last``, both included; either end may be open."""
    if first is not None:
        rows = rows.where(F.col(date) >= F.lit(first).cast("date"))
    return rows if last is None else rows.where(F.col(date) <= F.lit(last).cast("date"))


def with_columns(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with a null column for each of the schema that is missing."""
    kinds = rows.sparkSession.createDataFrame([], schema).schema
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in kinds if f.name not in rows.columns})


def looks_like_isin(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.coalesce((F.length(t) == 12) & t.startswith("INF"), F.lit(False))


def plan_label(plan: Column, option: Column) -> Column:
    """'PLAN/OPTION' of a fund as the fund map has them; 'unknown' without either."""
    return F.coalesce(F.concat(plan, F.lit("/"), option), F.lit("unknown"))


def find_funds(fund_map: DataFrame, query: str, by_id: bool = False) -> DataFrame:
    """Funds with all words of the query as whole words of a name (or with that id): latest such name and category."""
    return latest_names(fund_map.where(F.col("fund_id") == query if by_id else has_words(F.col("scheme_name"), query)))


def isin_groups(scheme: DataFrame) -> DataFrame:
    """(isin, amfi_code): the codes that ever had an ISIN and may be joined to one series.

    Where codes of several known options share an ISIN, those of the commonest option (on ties of the one seen
    first, by first_nav_date and code) and of no known option stay.
    """
    rows = scheme.where("isin_growth is not null").select(F.col("isin_growth").alias("isin"), "amfi_code", F.when(F.col("option") != "UNKNOWN", F.col("option")).alias("known"), "first_nav_date")
    seen = F.struct(F.col("first_nav_date").isNull(), "first_nav_date", "amfi_code")
    counts = rows.where("known is not null").groupBy("isin", "known").agg(F.count(F.lit(1)).alias("k"), F.min(seen).alias("seen"))
    main = counts.groupBy("isin").agg(F.min_by("known", F.struct(-F.col("k"), "seen")).alias("main"))
    return rows.join(main, "isin", "left").where("known is null or known = main").select("isin", "amfi_code")


def isin_series(scheme: DataFrame, nav: DataFrame) -> DataFrame:
    """(isin, nav_date, nav, amfi_code): the prices of all codes of an ISIN."""
    return nav.join(isin_groups(scheme), "amfi_code").select("isin", "nav_date", "nav", "amfi_code")


def worst_funds(jumps: DataFrame, k: int) -> DataFrame:
    """The ``k`` funds with the largest absolute jump, each once with it; ties go to the smaller id."""
    worst = jumps.groupBy("fund_id").agg(F.max(F.abs("lr")).alias("worst"), F.max_by("d", F.struct(F.abs("lr"), "d")).alias("d"))
    return worst.orderBy(F.desc("worst"), "fund_id").limit(k)


def pooled_winners(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Repeat winners of all years of a horizon together, of years with ``least`` winners: n, repeats, rate, z."""
    from .trailing import repeat_winners

    out = repeat_winners(pairs, least).groupBy("horizon_y").agg(F.sum("n").alias("n"), F.sum("repeats").alias("repeats"))
    rate = F.col("repeats") / F.col("n")
    return out.withColumns({"rate": rate, "z": (rate - 0.5) / F.sqrt(0.25 / F.col("n"))})


def pooled_spearman(pairs: DataFrame) -> DataFrame:
    """Rank correlation over all years of a horizon, ties at their mean rank."""
    return ranks.correlation(pairs, "formation", "holding", ["horizon_y"])
