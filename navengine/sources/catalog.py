"""What a store holds: its tables and columns, the roles these play, and a second store beside the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names that a column of each role may have, the first that is found counts.
ROLES = {
    "date": ["nav_date", "date", "d", "asof_date", "nav_dt"],
    "code": ["scheme_code", "code", "amfi_code", "scheme_cd"],
    "nav": ["nav", "nav_value", "net_asset_value", "nav_val"],
    "name": ["scheme_name", "name", "scheme"],
    "isin_growth": ["isin_growth", "isin_div_payout_growth", "isin_payout", "isin"],
    "isin_div": ["isin_div", "isin_reinvest", "isin_div_reinvestment", "isin_reinvestment"],
    "category": ["category", "scheme_category", "cat"],
    "option": ["option", "option_type", "plan_option"],
    "plan": ["plan", "plan_type"],
    "status": ["status", "is_active", "staleness"],
    "house": ["amc", "amc_name", "fund_house"],
}


def attach(spark: SparkSession, folder: str, names: list[str], prefix: str = "src_") -> dict[str, DataFrame]:
    """Parquet tables of another store as views ``<prefix><name>``, to be read beside the current ones."""
    found = {prefix + n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    for name, rows in found.items():
        rows.createOrReplaceTempView(name)
    return found


def describe(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, column_type); schemas only, no table is read."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, column_type string")


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns); rows are counted from the files' footers."""
    each = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")) for t, df in tables.items()]
    return reduce(DataFrame.unionAll, each)


def role_columns(columns: list[str]) -> dict[str, str | None]:
    """The column of each role, in any case; None where no candidate is there."""
    held = {c.lower(): c for c in columns}
    return {role: next((held[c] for c in names if c in held), None) for role, names in ROLES.items()}


def role_tables(tables: dict[str, DataFrame]) -> tuple[str, str]:
    """(prices, schemes): the largest table with code, date and nav, and the smallest other one with code and name, else the prices again."""
    roles = {t: role_columns(df.columns) for t, df in tables.items()}
    rows = {r["table_name"]: r["n_rows"] for r in sizes(tables).collect()}  # one row a table
    prices = [t for t, r in roles.items() if r["code"] and r["date"] and r["nav"]]
    if not prices:
        raise ValueError("no table has columns for code, date and nav")
    first = max(prices, key=rows.get)
    others = [t for t, r in roles.items() if t != first and r["code"] and r["name"]]
    return first, min(others, key=rows.get, default=first)


#: What the engine calls the column of each role, and its type. Plan and option are left out where no column has them: then names tell them.
BOUND = {
    "date": ("d", "date"), "nav": ("nav", "double"), "code": ("amfi_code", "string"), "name": ("scheme_name", "string"), "isin_growth": ("isin_growth", "string"),
    "isin_div": ("isin_div", "string"), "category": ("category", "string"), "option": ("option", "string"), "plan": ("plan", "string"), "status": ("status", "string"), "house": ("amc", "string"),
}
OPTIONAL = ("plan", "option")


def bind(rows: DataFrame, roles: list[str]) -> DataFrame:
    """``rows`` by role: the engine's names and types; a typed null for a role that no column has, and nothing for an optional one."""
    held = role_columns(rows.columns)
    out = []
    for role in roles:
        name, kind = BOUND[role]
        if held[role] is not None:
            out.append(F.col(f"`{held[role]}`").cast(kind).alias(name))
        elif role not in OPTIONAL:
            out.append(F.lit(None).cast(kind).alias(name))
    return rows.select(*out)


def bound_store(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(prices, schemes) of a store, whatever its tables and columns are called; schemes come from the prices where there is no table of their own."""
    prices, schemes = role_tables(tables)
    nav = bind(tables[prices], ["code", "date", "nav"]).withColumnRenamed("amfi_code", "scheme_code")
    kept = bind(tables[schemes], ["code", "name", "isin_growth", "isin_div", "category", "option", "plan", "status", "house"])
    return nav, kept.distinct() if schemes == prices else kept


def samples(tables: dict[str, DataFrame], rows: int = 3) -> DataFrame:
    """(table_name, row, column_name, value): the first ``rows`` rows of each table in the order of all its columns, as texts."""
    each = []
    for t, df in tables.items():
        first = df.orderBy(*df.columns).limit(rows)
        cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))
        text = first.select(F.concat_ws("\x01", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("key"), cells.alias("cells"))
        listed = text.agg(F.array_sort(F.collect_list(F.struct("key", "cells"))).alias("all"))  # ``rows`` rows
        each.append(listed.select(F.lit(t).alias("table_name"), F.posexplode("all").alias("row", "r")).select("table_name", "row", F.explode("r.cells").alias("c")).select("table_name", "row", "c.*"))
    return reduce(DataFrame.unionAll, each)
