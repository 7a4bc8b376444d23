"""Semi-structured price reports as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import blank_to_null, option_of, plan_of, with_fallback
from ..operators.scan import running


def any_date(text: Column) -> Column:
    """dd-mm-yyyy, dd-Mon-yyyy or yyyy-mm-dd, else null."""
    return F.coalesce(*(F.try_to_date(text, f) for f in ("dd-MM-yyyy", "dd-MMM-yyyy", "yyyy-MM-dd")))


def history_report(lines: DataFrame, *kept: str) -> DataFrame:
    """Rows of (value) with eight fields, a numeric code, a positive price and a date; columns named in ``kept`` stay."""
    p = F.split("value", ";")
    f = lambda i: F.trim(F.get(p, F.lit(i)))
    rows = lines.where((F.size(p) == 8) & f(0).rlike("^[0-9]+$"))
    return rows.select(
        f(0).cast("int").alias("amfi_code"), f(1).alias("scheme_name"), with_fallback(plan_of, f(1), f(2)).alias("plan"), with_fallback(option_of, f(1), f(3)).alias("option"),
        blank_to_null(f(4)).alias("isin_growth"), blank_to_null(f(5)).alias("isin_div"), f(6).try_cast("double").alias("nav"), any_date(f(7)).alias("nav_date"), *kept,
    ).where("nav > 0 and nav_date is not null")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, pos, value): the lines of text files. A split is the part of a file that a task reads; pos orders the lines of a split."""
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    return spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("pos"), "value")


def _under_header(lines: DataFrame, head: Column, out: str, rows: int = 100_000) -> DataFrame:
    """``lines`` with the last header up to each. Splits (else segments of so many positions) hand their last header on; no task holds a file."""
    segment = F.col("split") if "split" in lines.columns else F.floor(F.col("pos") / rows)
    return running(lines, head, out, "last", ["file"], ["pos"], segment)


def current_list(lines: DataFrame) -> DataFrame:
    """(amfi_code, category): of (file, pos, value), the category of the section header before each row; a code's last row wins."""
    head = F.when(~F.col("value").contains(";"), F.nullif(F.regexp_extract("value", r"\((.*)\)\s*$", 1), F.lit("")))
    code = F.trim(F.get(F.split("value", ";"), F.lit(0)))
    rows = _under_header(lines, head, "category").where(F.col("value").contains(";") & code.rlike("^[0-9]+$") & F.col("category").isNotNull())
    place = [c for c in ("file", "split", "pos") if c in lines.columns]
    return rows.groupBy(code.cast("int").alias("amfi_code")).agg(F.max_by("category", F.struct(*place)).alias("category"))


PAYLOAD = "meta struct<fund_house:string,scheme_type:string,scheme_category:string,scheme_code:string,scheme_name:string,isin_growth:string,isin_div_reinvestment:string>, data array<struct<date:string,nav:string>>"


def json_payloads(rows: DataFrame) -> DataFrame:
    """One row for each good price of the JSON payloads in (value); a date's first price wins, and a payload without a code raises an error."""
    p = rows.select(F.from_json("value", PAYLOAD).alias("p"))
    code = F.coalesce(F.col("p.meta.scheme_code").cast("int"), F.raise_error(F.lit("payload without scheme_code")).cast("int"))
    name = F.coalesce("p.meta.scheme_name", F.lit(""))
    flat = p.select(code.alias("amfi_code"), name.alias("scheme_name"), F.col("p.meta.scheme_category").alias("category"), plan_of(name).alias("plan"), option_of(name).alias("option"), F.posexplode("p.data").alias("pos", "x"))
    good = flat.withColumns({"nav": F.col("x.nav").try_cast("double"), "nav_date": any_date(F.col("x.date"))}).where("nav > 0 and nav_date is not null")
    keys = ["amfi_code", "scheme_name", "category", "plan", "option", "nav_date"]
    return good.groupBy(*keys).agg(F.min_by("nav", "pos").alias("nav"))


def house_of_rows(lines: DataFrame) -> DataFrame:
    """(file, pos, amfi_code, house): of (file, pos, value), the last line without fields before each row of prices; a split, if there is one, stays."""
    text = F.trim("value")
    head = F.when(~F.col("value").contains(";") & (text != "") & ~F.lower(text).startswith("scheme code"), text)
    code = F.trim(F.get(F.split("value", ";"), F.lit(0)))
    place = [c for c in ("file", "split", "pos") if c in lines.columns]
    return _under_header(lines, head, "house").where(F.col("value").contains(";") & code.rlike("^[0-9]+$")).select(*place, code.cast("int").alias("amfi_code"), "house")
