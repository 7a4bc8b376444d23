"""What the columns of a table hold: nulls, dashes, blanks, bounds and frequent values, all columns in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def _cells(rows: DataFrame, columns: list[str] | None) -> DataFrame:
    """(column, position, value): a row for each cell."""
    names = [f for f in (columns or rows.columns)]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names, 1)))
    return rows.select(F.explode(cells).alias("c")).select("c.*")


def columns(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, position, n, n_null, n_dash, n_blank, n_known, shortest, longest, low, high): a row for each column, none for an empty table.

    A dash and a blank count as unknown, as in reports. low and high are the bounds of the known values as texts.
    """
    t = F.trim("value")
    known = F.when((t != "-") & (t != ""), F.col("value"))
    return _cells(rows, columns).groupBy("column", "position").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(t == "-").alias("n_dash"), F.count_if(t == "").alias("n_blank"),
        F.count(known).alias("n_known"), F.min(F.char_length(known)).alias("shortest"), F.max(F.char_length(known)).alias("longest"), F.min(known).alias("low"), F.max(known).alias("high"),
    )


def value_mix(rows: DataFrame, columns: list[str] | None = None, share: float = 0.02) -> DataFrame:
    """(column, value, n, share): every value that fills at least ``share`` of its column, with its exact count.

    A summary of bounded size finds candidates, all such values among them: it tracks so many items that none with that share is lost.
    A second pass counts the candidates, a few hundred for each column. Nulls are a value.
    """
    tracked = 1 << max(5, int(4 / share - 1).bit_length())
    cells = _cells(rows, columns).withColumn("value", F.struct(F.col("value").isNull().alias("none"), F.coalesce("value", F.lit("")).alias("text")))
    text = F.concat(F.col("value.none").cast("string"), F.lit(":"), F.col("value.text"))
    cells = cells.select("column", text.alias("value"))
    found = cells.groupBy("column").agg(F.expr(f"approx_top_k(value, {min(tracked // 2, 10_000)}, {tracked})").alias("top"), F.count(F.lit(1)).alias("all"))
    asked = written(found.select("column", "all", F.explode("top.item").alias("value")), "candidates")
    counted = cells.join(F.broadcast(asked), ["column", "value"]).groupBy("column", "value", "all").agg(F.count(F.lit(1)).alias("n"))
    plain = F.when(F.col("value").startswith("false:"), F.substr("value", F.lit(7)))
    return counted.where(F.col("n") >= F.lit(share) * F.col("all")).select("column", plain.alias("value"), "n", (F.col("n") / F.col("all")).alias("share"))


def splices(scheme: DataFrame, k: int = 10) -> DataFrame:
    """(isin, codes, names): the ``k`` ISINs with most codes, of those with several; ties by ISIN."""
    isin = F.nullif(F.trim("isin_growth"), F.lit("-"))
    g = scheme.where(isin.isNotNull()).groupBy(isin.alias("isin")).agg(F.count_distinct("amfi_code").alias("codes"), F.array_join(F.array_sort(F.collect_set("scheme_name")), " | ").alias("names"))
    return g.where("codes > 1").orderBy(F.desc("codes"), "isin").limit(k)


def inferred(scheme: DataFrame, name: str = "scheme_name") -> DataFrame:
    """(field, value, n): plan and option as the name alone tells them, where there is no column for them."""
    from ..functions.classify import option_by_name, plan_by_name

    both = F.array(F.struct(F.lit("plan").alias("field"), plan_by_name(F.col(name)).alias("value")), F.struct(F.lit("option").alias("field"), option_by_name(F.col(name)).alias("value")))
    return scheme.select(F.explode(both).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
