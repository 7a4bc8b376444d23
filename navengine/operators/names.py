"""Searches in names through an inverted index of their parts of three letters, by equi-joins.

A name that holds a text holds all its runs of three letters. Of each query's runs only the rarest is looked up, and the names found are
then tested exactly; so neither names nor queries are ever held against all of the other, however many there are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n letters; of 0, the empty one."""
    if n == 0:
        return F.array(F.lit(""))
    starts = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def candidates(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, name): the names that may hold the query's piece, all that do among them.

    names: (name), distinct. queries: (query, piece), distinct, with a lower-case piece that the lower-case name must hold. A piece
    shorter than three letters is looked up whole; an empty one is in every name. Null pieces and names are in none.
    """
    size = F.least(F.char_length("piece"), F.lit(GRAM))
    asked = queries.where("piece is not null").select("query", "piece", size.alias("n"))
    sizes = [r["n"] for r in asked.select("n").distinct().collect()]  # at most four
    if not sizes:
        return queries.select("query", F.lit(None).cast("string").alias("name")).where("false")
    by_size = F.coalesce(*(F.when(F.col("n") == n, _grams(F.col("piece"), n)) for n in sizes))
    wanted = asked.select("query", F.explode(by_size).alias("gram"))
    lower = F.lower("name")
    posted = names.select("name", F.explode(F.concat(*(_grams(lower, n) for n in sizes))).alias("gram"))
    posted = posted.join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    rarest = wanted.join(counts, "gram", "left").groupBy("query").agg(F.min_by("gram", F.struct(F.coalesce("k", F.lit(0)).alias("k"), "gram")).alias("gram"))
    return rarest.join(posted, "gram").select("query", "name")


def holding(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, name): names that hold the query, trimmed, in any case; an empty query is in none."""
    asked = queries.select("query").distinct().withColumn("piece", F.lower(F.trim("query"))).where("piece <> ''")
    found = candidates(names.select("name").distinct(), asked)
    return found.where(F.lower("name").contains(F.lower(F.trim("query"))))


def like(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query, name): names that match the patterns (query) of ILIKE, with % and _ and the backslash before a letter that stands for itself."""
    literal = F.regexp_replace(F.lower("query"), r"\\(.)", "\u0001$1")  # an escaped letter ends a piece, and begins none
    pieces = F.transform(F.split(literal, "[%_]|\u0001."), lambda p: F.struct((-F.char_length(p)).alias("size"), p.alias("piece")))
    asked = patterns.select("query").distinct().where("query is not null").withColumn("piece", F.array_min(pieces)["piece"])
    return candidates(names.select("name").distinct(), asked).where(F.expr("name ilike query"))


def with_words(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, name): names in which all words of the query stand as whole words, in any order and case; a query without words is in every name.

    The longest word is looked up.
    """
    words = F.filter(F.split(F.trim(F.lower("query")), r"\s+"), lambda w: w != "")
    longest = F.array_min(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("size"), w.alias("word"))))["word"]
    asked = queries.select("query").distinct().where("query is not null").withColumn("piece", F.coalesce(longest, F.lit("")))
    found = candidates(names.select("name").distinct(), asked)
    quoted = lambda w: F.concat(F.lit(r"\b"), F.regexp_replace(w, r"([^\w\s])", r"\\$1"), F.lit(r"\b"))
    return found.where(F.forall(words, lambda w: F.regexp_like(F.lower("name"), quoted(w))))


def escaped(text: str) -> str:
    """The text as a pattern of ILIKE that stands for itself."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def resolve(queries: DataFrame, fund_map: DataFrame, is_id: Column | None = None) -> DataFrame:
    """One row for each distinct query: query, fund_id, scheme_name, category, n_matches, reason.

    A query for which ``is_id`` holds (by default one of the shape of an ISIN) is matched with ids alone, as it stands but for blanks around it; any other with a part of a name. Matches are distinct (fund_id, scheme_name, category). One match gives the
    fund and a null reason; none and several give the reason and no fund. Queries are never lost; a null one has no match.
    """
    from .selection import looks_like_isin

    asked = queries.select("query").distinct()
    shape = F.coalesce(looks_like_isin(F.col("query")) if is_id is None else is_id, F.lit(False))
    funds = fund_map.select("fund_id", "scheme_name", "category").distinct()
    ids = asked.where(shape).join(funds, F.trim("query") == F.col("fund_id"))
    parts = holding(funds.select(F.col("scheme_name").alias("name")), asked.where(~shape)).join(funds, F.col("name") == F.col("scheme_name"))
    cols = ["query", "fund_id", "scheme_name", "category"]
    found = ids.select(*cols).unionByName(parts.select(*cols)).groupBy(F.col("query").alias("__q"))
    found = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*cols[1:])).alias("m"))
    one = asked.join(found, F.col("query") == F.col("__q"), "left").withColumn("n_matches", F.coalesce("n", F.lit(0)).cast("long"))
    only = lambda c: F.when(F.col("n_matches") == 1, F.col(f"m.{c}")).alias(c)
    reason = F.when(F.col("n_matches") == 0, "no match").when(F.col("n_matches") > 1, F.concat("n_matches", F.lit(" matches")))
    return one.select("query", *(only(c) for c in cols[1:]), "n_matches", reason.alias("reason"))
