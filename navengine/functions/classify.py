"""Classifiers of fund names, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of scheme names.
PAYOUT_WORDS = ("idcw", "dividend", "payout", "reinvest", "bonus", "income distribution", "capital withdrawal")
# Words of names that speak of a payout, where there is no column for it.
PAYOUT_NAMES = ("idcw", "dividend", "income distribution")
# Terms of closed-end schemes that stand as whole words, and forms that may stand anywhere.
CLOSED_END_TERMS = ("fmp", "ftp", "fixed maturity", "fixed term", "fixed horizon", "fixed tenure", "interval", "capital protection", "dual advantage", "capital builder", "infrastructure debt")
CLOSED_END_FORMS = (r"close[d]?[\s-]?end", r"\(\s*\d{2,5}\s*days?\s*\)")
CLOSED_END = "(?i)" + "|".join([*(rf"\b{t}\b" for t in CLOSED_END_TERMS), *CLOSED_END_FORMS])


def plan_of(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("direct"), "DIRECT").when(n.contains("regular"), "REGULAR").otherwise("UNKNOWN")


def option_of(name: Column) -> Column:
    """Payout words win over growth."""
    n = F.lower(name)
    return F.when(n.rlike("|".join(PAYOUT_WORDS)), "IDCW").when(n.contains("growth"), "GROWTH").otherwise("UNKNOWN")


def plan_by_name(name: Column) -> Column:
    """Where there is no column for the plan: what is not called direct is regular."""
    return F.when(F.lower(name).contains("direct"), "DIRECT").otherwise("REGULAR")


def option_by_name(name: Column) -> Column:
    """Where there is no column for the option: what speaks of no payout grows."""
    return F.when(F.lower(name).rlike("|".join(PAYOUT_NAMES)), "IDCW").otherwise("GROWTH")


def with_fallback(classifier, name: Column, column: Column) -> Column:
    """From the name; where that says nothing, from the report's own column."""
    first = classifier(name)
    return F.when(first != "UNKNOWN", first).otherwise(classifier(F.coalesce(column, F.lit(""))))


def is_closed_end(name: Column) -> Column:
    return F.coalesce(name.rlike(CLOSED_END), F.lit(False))


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when((t != "") & (t != "-"), t)


def fund_id(isin_growth: Column, isin_div: Column, code: Column) -> Column:
    return F.coalesce(blank_to_null(isin_growth), blank_to_null(isin_div), F.concat(F.lit("CODE:"), code.cast("string")))


def has_words(name: Column, query: str) -> Column:
    """All words of the query stand in the name as whole words, in any order, in any case."""
    out = F.lit(True)
    for word in query.split():
        out = out & name.rlike(rf"(?i)\b{re.escape(word)}\b")
    return F.coalesce(out, F.lit(False))


def category_key(name: Column) -> Column:
    """Normal form of a category's spelling."""
    n = F.regexp_replace(F.lower(F.trim(name)), "schemes", "scheme")
    n = F.regexp_replace(F.regexp_replace(n, r"\bfund\b", " "), "[^a-z0-9]+", " ")
    return F.trim(n)
