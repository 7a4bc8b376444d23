"""Stable fund identities over administrative codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.classify import blank_to_null, category_key, fund_id, option_by_name, plan_by_name
from .selection import in_categories


def fund_map(scheme: DataFrame, plan: str = "REGULAR", categories: list[str] | None = None) -> DataFrame:
    """Codes of one plan's growth options with a category, and the identity each belongs to.

    Without a column for plan or option, the name tells it. ``categories`` keeps those that have one of these parts, in any case.
    """
    name = F.col("scheme_name")
    p = F.when(F.upper(F.coalesce("plan", F.lit(""))).contains("DIRECT"), "DIRECT").otherwise("REGULAR") if "plan" in scheme.columns else plan_by_name(name)
    o = F.when(F.upper(F.coalesce("option", F.lit(""))).contains("GROWTH"), "GROWTH").otherwise("IDCW") if "option" in scheme.columns else option_by_name(name)
    ids = fund_id(F.col("isin_growth"), F.col("isin_div"), F.col("amfi_code"))
    none = blank_to_null(F.col("isin_growth")).isNull() & blank_to_null(F.col("isin_div")).isNull()
    out = scheme.select(F.col("amfi_code").cast("string").alias("scheme_code"), "scheme_name", "category", p.alias("plan"), o.alias("option_type"), ids.alias("fund_id"), none.alias("no_isin"))
    return out.where((F.col("plan") == plan) & (F.col("option_type") == "GROWTH") & F.col("category").isNotNull() & in_categories(F.col("category"), categories or []))


def spliced_nav(nav: DataFrame, mapping: DataFrame) -> DataFrame:
    """One price for each fund and day: of the code with most rows, then the lowest code, then the highest price.

    nav: scheme_code, d, nav. mapping: scheme_code, fund_id.
    """
    good = nav.where("nav > 0")
    rank = good.groupBy("scheme_code").agg(F.count(F.lit(1)).alias("n"))
    rows = good.join(mapping.select("scheme_code", "fund_id").join(rank, "scheme_code"), "scheme_code")
    best = F.min_by("nav", F.struct(-F.col("n"), "scheme_code", -F.col("nav")))
    return rows.groupBy("fund_id", "d").agg(best.alias("nav"))


def category_map(categories: DataFrame) -> DataFrame:
    """(raw_category, canonical_category): of the spellings with one normal form, the only one without "schemes", else the shortest, ties by name."""
    c = categories.select(F.col("category").alias("raw_category")).where("raw_category is not null").distinct().withColumn("key", category_key(F.col("raw_category")))
    w = W.partitionBy("key")
    plain = F.when(~F.lower("raw_category").contains("schemes"), F.col("raw_category"))
    one = F.when(F.count(plain).over(w) == 1, F.max(plain).over(w))
    short = F.min_by("raw_category", F.struct(F.length("raw_category"), "raw_category")).over(w)
    return c.select("raw_category", F.coalesce(one, short).alias("canonical_category"))
