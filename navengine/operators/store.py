"""Keyed tables as pure functions of (current, batch): merges that never erase what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import blank_to_null
from . import names


def upsert_schemes(current: DataFrame, batch: DataFrame, position: str = "pos", now: Column | None = None) -> DataFrame:
    """By amfi_code: names are replaced; other fields only by values; a plan or option never by UNKNOWN.

    Rows of a code in one batch count as if they came one after the other, by ``position`` if the batch has it. Columns go by name; those that
    only the batch has are added. With ``now``, updated_at is set for the codes of the batch.
    """
    at = F.col(position) if position in batch.columns else F.lit(0)
    fields = [x for x in batch.columns if x not in ("amfi_code", position)]
    says = lambda x: F.col(x).isNotNull() & ((F.col(x) != "UNKNOWN") if x in ("plan", "option") else F.lit(True))
    last = lambda x: F.coalesce(F.max_by(x, F.when(says(x), F.struct(at, F.col(x)))), F.max(x))
    c, b = current.alias("c"), batch.groupBy("amfi_code").agg(*(last(x).alias(x) for x in fields)).alias("b")
    both = c.join(b, F.col("c.amfi_code") == F.col("b.amfi_code"), "full")
    known = lambda x: F.when(F.col(f"b.{x}").isNull() | ((F.col(f"b.{x}") == "UNKNOWN") & (F.col(f"c.{x}") != "UNKNOWN")), F.coalesce(f"c.{x}", f"b.{x}")).otherwise(F.col(f"b.{x}"))
    out = [F.coalesce("b.amfi_code", "c.amfi_code").alias("amfi_code"), F.coalesce("b.scheme_name", "c.scheme_name").alias("scheme_name")]
    for x in [n for n in (*current.columns, *(f for f in fields if f not in current.columns)) if n not in ("amfi_code", "scheme_name")]:
        if x == "updated_at" and now is not None:
            value = F.when(F.col("b.amfi_code").isNotNull(), now).otherwise(F.col("c.updated_at"))
        elif x not in fields:
            value = F.col(f"c.{x}")
        elif x not in current.columns:
            value = F.col(f"b.{x}")
        else:
            value = known(x) if x in ("plan", "option") else F.coalesce(f"b.{x}", f"c.{x}")
        out.append(value.alias(x))
    return both.select(*out)


def upsert_nav(current: DataFrame, batch: DataFrame, position: str = "pos") -> DataFrame:
    """By (code, date): the batch wins, and in the batch the last position."""
    rows = current.withColumn("__o", F.struct(F.lit(0).alias("side"), F.lit(None).cast(batch.schema[position].dataType).alias("at"))).unionByName(batch.select(*current.columns, F.struct(F.lit(1).alias("side"), F.col(position).alias("at")).alias("__o")))
    return rows.groupBy("amfi_code", "nav_date").agg(F.max_by("nav", "__o").alias("nav"))


def insert_ignore(current: DataFrame, batch: DataFrame, *key: str) -> DataFrame:
    return current.unionByName(batch.dropDuplicates(list(key)).join(current, list(key), "left_anti"))


def bounds(scheme: DataFrame, nav: DataFrame) -> DataFrame:
    """First and last date of each code."""
    b = nav.groupBy("amfi_code").agg(F.min("nav_date").alias("first_nav_date"), F.max("nav_date").alias("last_nav_date"))
    return scheme.drop("first_nav_date", "last_nav_date").join(b, "amfi_code", "left")


def mark_stale(scheme: DataFrame, asof: str, days: int = 30) -> DataFrame:
    old = F.col("last_nav_date") < F.date_sub(F.lit(asof).cast("date"), days)
    return scheme.withColumn("status", F.when((F.col("status") == "ACTIVE") & old, "STALE").otherwise(F.col("status")))


def inherit_category(scheme: DataFrame) -> DataFrame:
    """A missing category from codes with the same isin_growth; a dash, a blank and null are no ISIN."""
    isin = blank_to_null(F.col("isin_growth"))
    known = scheme.where(isin.isNotNull() & F.col("category").isNotNull()).groupBy(isin.alias("__isin")).agg(F.max("category").alias("__c"))
    return scheme.join(known, isin == F.col("__isin"), "left").withColumn("category", F.coalesce("category", "__c")).drop("__isin", "__c")


def fill_category(scheme: DataFrame, mapping: DataFrame) -> DataFrame:
    """Only where it is missing."""
    m = mapping.select("amfi_code", F.col("category").alias("__c"))
    return scheme.join(m, "amfi_code", "left").withColumn("category", F.coalesce("category", "__c")).drop("__c")


def universe_as_of(scheme: DataFrame, snapshot: DataFrame, day: str) -> DataFrame:
    return scheme.join(snapshot.where(F.col("snap_date") == F.lit(day).cast("date")), "amfi_code", "left_semi")


def manual_mapping(scheme: DataFrame, curated: DataFrame) -> DataFrame:
    """(amfi_code, category) for curated rows (amfi_code, candidates: patterns in order) whose code has no category.

    The first candidate that a categorised name matches decides; of its matches, the lowest code.
    """
    tries = curated.select("amfi_code", F.posexplode("candidates").alias("at", "pattern"))
    open_ = tries.join(scheme.where("category is null").select("amfi_code"), "amfi_code", "left_semi")
    donors = scheme.where("category is not null").groupBy(F.col("scheme_name").alias("name")).agg(F.min_by(F.struct(F.col("amfi_code").alias("donor"), F.col("category").alias("given")), "amfi_code").alias("m"))
    hits = names.like(donors.select("name"), open_.select(F.col("pattern").alias("query")))
    found = open_.join(hits, F.col("pattern") == F.col("query")).join(donors, "name")
    return found.groupBy("amfi_code").agg(F.min_by("m.given", F.struct("at", "m.donor")).alias("category"))


def category_chain(scheme: DataFrame, listing: DataFrame, curated: DataFrame, only_direct_growth: bool = False) -> DataFrame:
    """(amfi_code, category, origin): what each step of the chain gives the codes without a category.

    First the current list (amfi_code, category) (origin list), then the curated mapping, which may take from what the list gave, and last codes of the same ISIN. Earlier steps win.
    """
    missing = scheme.where("category is null").where("plan = 'DIRECT' and option = 'GROWTH'" if only_direct_growth else "true").select("amfi_code")
    after = fill_category(scheme, listing)
    by_hand = manual_mapping(after, curated)
    last = inherit_category(fill_category(after, by_hand)).select("amfi_code", F.col("category").alias("__is"))
    steps = after.select("amfi_code", F.col("category").alias("__list")).join(by_hand.withColumnRenamed("category", "__hand"), "amfi_code", "left").join(last, "amfi_code")
    origin = F.when(F.col("__list").isNotNull(), "list").when(F.col("__hand").isNotNull(), "curated").otherwise("sibling")
    return missing.join(steps, "amfi_code").where("__is is not null").select("amfi_code", F.col("__is").alias("category"), origin.alias("origin"))
