"""Line deduplication with a fixed-depth tree of line templates, in DataFrame functions only.

A line's tokens are its runs without white space, and a token with a digit is
a variable field; lines of one or two tokens have none and match exactly. The tree has two fixed levels, the count of tokens and the
leading tokens, which lead to a leaf. In a leaf, lines that agree with the leaf's commonest line
in enough places share its template (the places that differ are variable fields);
lines that do not are held against the commonest of the rest, and so on until no line is open. A template of several documents is recurring: its
lines are dropped from all documents but the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

FIELD = "<*>"


def _bound(value: Column, use) -> Column:
    """``use(value)``, with value computed once."""
    return F.transform(F.array(value), use)[0]


def _tokens(line: Column) -> Column:
    masked = lambda t: F.transform(t, lambda x: F.when(x.rlike("[0-9]"), FIELD).otherwise(x))
    whole = F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), r"\s+")
    return _bound(whole, lambda t: F.when((F.size(t) < 3) | ~line.rlike("[0-9]"), t).otherwise(masked(t)))


def _counts(tokens: Column, least_tokens: int) -> Column:
    """Whether a line has so many tokens; a blank one has none."""
    return (F.size(tokens) >= least_tokens) & (tokens[0] != "")


def _place(tokens: Column, depth: int) -> Column:
    """(leaf, line): hashes of the way through the tree and of the line with its fields masked."""
    return F.struct(F.xxhash64(F.size(tokens), F.slice(tokens, 1, depth)).alias("leaf"), F.xxhash64(tokens).alias("line"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _places(docs: DataFrame, depth: int, least_tokens: int) -> DataFrame:
    """(doc, leaf, line), each line of a row once."""
    tokens = F.filter(F.transform(_lines(F.col("text")), _tokens), lambda t: _counts(t, least_tokens))
    return docs.select("doc", F.explode(F.array_distinct(F.transform(tokens, lambda t: _place(t, depth)))).alias("p")).select("doc", "p.leaf", "p.line")


def _fits(tokens: Column, pattern: Column, similarity: float) -> Column:
    same = F.size(F.filter(F.zip_with(tokens, pattern, lambda a, b: a.eqNullSafe(b)), lambda x: x))
    return same >= similarity * F.size(tokens)


def _known(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _templates(docs: DataFrame, lines: DataFrame, depth: int, least_tokens: int, least_docs: int, similarity: float, batch: int, broadcast_rows: int) -> DataFrame:
    """(leaf, line, template): of the lines in leaves of several lines, which template each belongs to.

    In each round a leaf's ``batch`` commonest open lines become templates, but for those that fit a commoner one;
    a line belongs to the commonest template that it fits. So a round closes as many lines of a leaf at least.
    """
    leaves = lines.groupBy("leaf").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    busy = materialize(leaves.where((F.col("total") >= least_docs) & (F.col("kinds") > 1)).select("leaf"), "busy")
    tokens = F.filter(F.transform(_lines(F.col("text")), _tokens), lambda t: _counts(t, least_tokens))
    placed = F.transform(tokens, lambda t: F.struct(_place(t, depth).alias("p"), t.alias("tokens")))
    found = docs.select(F.explode(placed).alias("x")).select("x.p.leaf", "x.p.line", "x.tokens").join(_known(busy, broadcast_rows), "leaf", "left_semi")
    found = found.groupBy("leaf", "line").agg(F.min("tokens").alias("tokens"))
    left = materialize(found.join(lines.select("line", "leaf", "n"), ["leaf", "line"]), "leaf_lines")
    out = None
    while True:
        top = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("n"), F.desc("line")))
        best = left.withColumn("at", top).where(F.col("at") <= batch).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("n", "line", "tokens")), asc=False).alias("best"))
        none = F.filter("best", lambda m: F.lit(False))
        heads = F.aggregate("best", none, lambda known, m: F.when(F.exists(known, lambda h: _fits(m["tokens"], h["tokens"], similarity)), known).otherwise(F.concat(known, F.array(m))))
        head = materialize(best.select("leaf", heads.alias("heads")), "heads")
        first = F.get(F.filter("heads", lambda h: _fits(F.col("tokens"), h["tokens"], similarity)), F.lit(0))
        held = materialize(left.join(head, "leaf").select("leaf", "line", "tokens", "n", first["line"].alias("template")), "held")
        fits = held.where("template is not null").select("leaf", "line", "template")
        out = fits if out is None else out.unionByName(fits)
        left = held.where("template is null").drop("template")
        if left.isEmpty():
            break
        batch = min(2 * batch, 1024)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, least_tokens: int = 1, least_docs: int = 2, similarity: float = 0.6, batch: int = 64, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from the texts of all documents but the first, plus n_lines and n_dropped.

    A template recurs if lines of it stand in at least ``least_docs`` documents; the first
    is the one with the smallest id, and keeps its lines. Lines of fewer than ``least_tokens`` tokens and blank
    lines always stay. Rows with the same id count as one document, and so do
    rows with a null id, which comes after all others. A null text stays null, and an empty one empty, with n_dropped 0. Texts are split whole at line feeds and
    joined again. All columns stay (a former n_lines or n_dropped is replaced); an empty table stays empty.
    """
    doc, text = F.col(id_col), F.col(text_col).cast("string")
    base = docs.select(doc.alias("doc"), text.alias("text"))
    places = _places(base, depth, least_tokens)
    if not base.groupBy("doc").count().where("count > 1").isEmpty():
        places = places.distinct()  # a line of several rows of a document counts once
    places = materialize(places, "places")  # read three times
    lines = materialize(places.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")), "lines")
    merged = materialize(_templates(base, lines, depth, least_tokens, least_docs, similarity, batch, broadcast_rows), "templates")
    # Documents of a template of several lines are counted themselves; of a single line they are known.
    several = merged.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("leaf", "template")
    joined = materialize(merged.join(several, ["leaf", "template"], "left_semi"), "joined")
    counted = places.join(_known(joined, broadcast_rows), ["leaf", "line"]).select("leaf", "template", "doc").distinct()
    counted = counted.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where(F.col("n") >= least_docs)
    of_several = joined.join(counted, ["leaf", "template"]).select("leaf", "line", "first")
    single = lines.where((F.col("n") >= least_docs) & (F.col("n") > 1)).join(joined.select("leaf", "line"), ["leaf", "line"], "left_anti")
    recurring = materialize(of_several.unionByName(single.select("leaf", "line", "first")), "recurring")
    drops = places.join(_known(recurring, broadcast_rows), ["leaf", "line"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    drops = materialize(drops.groupBy("doc").agg(F.collect_set("line").alias("__nav_drop")).withColumnRenamed("doc", "__nav_doc"), "drops")
    size = drops.agg(F.sum(F.size("__nav_drop") + 4)).first()[0] or 0
    known = F.broadcast(drops) if size <= 4 * broadcast_rows else drops  # eight bytes each
    all_ = _lines(text)
    dropped = F.coalesce(F.col("__nav_drop"), F.array().cast("array<bigint>"))
    stays = F.filter(all_, lambda x: ~F.array_contains(dropped, F.xxhash64(_tokens(x))))  # lines that do not count are never in dropped
    out = docs.drop("n_lines", "n_dropped").join(known, doc.eqNullSafe(F.col("__nav_doc")), "left")
    out = out.withColumn("__nav_stays", F.when(F.col("__nav_drop").isNull(), all_).otherwise(stays)).withColumn("n_lines", F.size(all_))
    out = out.withColumns({"n_dropped": F.coalesce(F.col("n_lines") - F.size("__nav_stays"), F.lit(0)), text_col: F.array_join("__nav_stays", "\n")})
    return out.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).drop("__nav_stays", "__nav_drop", "__nav_doc")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
