"""Spelling variants by an errata trie: words that differ by one inserted, deleted or replaced code point.

The trie of all words is a table of prefixes with the count of words below. The child with most words
is a node's heavy child, and the paths of heavy children decompose the trie; a word lies in light subtrees of at most
log2(words) nodes. At a node the light subtrees (and a word that ends there) are merged, small to large, with one
code point replaced by any or by the heavy child's, skipped, or put in before them. Where the ends of two words coincide, they are
a pair, at the node where they part, and so each pair is found once. Subtrees are merged as keys of words (node, rest), which Spark groups and joins.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

RUNS = "([A-Za-z\\u00C0-\\u00FF]+)"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(id, run): every maximal run of Latin letters of at least ``least`` code points, with A to Z lower-cased; null and empty texts have none."""
    found = F.transform(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUNS), F.lit(1)), lambda r: F.translate(r, ascii_uppercase, ascii_lowercase))
    return docs.select(F.col(id_col).alias("id"), F.explode(F.filter(found, lambda r: F.char_length(r) >= least)).alias("run"))


def misspelt(id_: Column, run: Column, every: int = 199) -> Column:
    """The run; one in ``every``, by the crc32 of ``<id>:<run>``, without one of its code points. A null id counts as an empty text."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % every == 0, cut).otherwise(run)


def _best(n: Column, word: Column) -> Column:
    """Smaller is better: most occurrences, then the first word in code-point order."""
    return F.struct((-n).alias("minus"), word.alias("word"))


def _parts(words: DataFrame, top_rows: int) -> DataFrame:
    """(word, n, at, prefix, char, heavy, rest): every light subtree that each word lies in; char and rest are empty where the word ends.

    Nodes with many words below are broadcast: as a node has a row for each word below it, fewer than
    ``top_rows`` of them have more than rows / top_rows. The others are joined by prefix, and no prefix has more rows than that.
    """
    at = F.explode(F.sequence(F.lit(0), F.char_length("word")))
    rows = words.select("word", "n", at.alias("at"))
    rows = rows.select("word", "n", "at", F.substr("word", F.lit(1), F.col("at")).alias("prefix"), F.substr("word", F.col("at") + 1, F.lit(1)).alias("char"))
    kids = rows.groupBy("prefix", "char").agg(F.count(F.lit(1)).alias("below"))
    inner = F.when(F.col("char") != "", F.struct("below", "char"))
    nodes = kids.groupBy("prefix").agg(F.max(inner)["char"].alias("heavy"), F.sum("below").alias("below"), F.count(F.lit(1)).alias("children"))
    nodes = materialize(nodes.where("children > 1"), "nodes")  # elsewhere nothing parts
    total = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    many = max(1000, -(-total // top_rows))
    top = F.broadcast(nodes.where(F.col("below") > many).select("prefix", F.col("heavy").alias("top")))
    seen = rows.join(top, "prefix", "left")
    hot = seen.where("top is not null").withColumnRenamed("top", "heavy")
    cold = seen.where("top is null").drop("top").join(nodes.where(F.col("below") <= many).select("prefix", "heavy"), "prefix")
    light = hot.unionByName(cold).where("char <> heavy")
    return light.withColumn("rest", F.substr("word", F.col("at") + 2))


def near_words(words: DataFrame, top_rows: int = 200_000) -> DataFrame:
    """(word, n_near, best): how many words are near each word that has any, and the near word of largest n as (minus, word).

    words: distinct non-null words and their n. What a key gathers is at most as many words as there are code points that may stand in one place.
    """
    light = materialize(_parts(words, top_rows), "light")
    start, letter = F.col("prefix"), F.col("char") != ""
    replaced = F.when(letter, F.concat(start, "heavy", "rest"))
    skipped = F.when(letter & (F.substr("rest", F.lit(1), F.lit(1)) != F.col("char")), F.concat(start, "rest"))
    put_in = F.concat(start, "heavy", "char", "rest")
    asked = light.select("word", "n", F.explode(F.array(replaced, skipped, put_in)).alias("other")).where("other is not null")
    met = asked.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    one = met.select("word", F.lit(1).alias("k"), _best(F.col("other_n"), F.col("other")).alias("best"))
    two = met.select(F.col("other").alias("word"), F.lit(1).alias("k"), _best(F.col("n"), F.col("word")).alias("best"))
    # Words of different light subtrees with the same rest: one code point replaced by any.
    mine = _best(F.col("n"), F.col("word"))
    group = Window.partitionBy("at", "merged")
    ordered = group.orderBy("mine")
    merged = light.where(letter).select("word", "at", F.concat(start, "rest").alias("merged"), mine.alias("mine"))
    merged = merged.select("word", (F.count(F.lit(1)).over(group) - 1).alias("k"), F.row_number().over(ordered).alias("place"), F.min("mine").over(group).alias("first"), F.lead("mine").over(ordered).alias("next"))
    three = merged.where("k > 0").select("word", "k", F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("first")).alias("best"))
    return one.unionByName(two).unionByName(three).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def spelling_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word's commoner spelling, and where following it ends.

    words: (word, n); rows with a null word go, n of repeated words is added up, and a null n counts as 0. Words are near that differ by exactly
    one inserted, deleted or replaced code point. A word's form is the near word of largest n (ties: the first in
    code-point order) if that n is positive and at least ``factor`` times its own, else null; factor must be above 1. root is the word itself where there is no form.
    Empty tables give no rows, and other columns are not read.
    """
    if factor <= 1:
        raise ValueError("factor must be above 1, or forms may lead in a circle")
    words = words.where("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    words = materialize(words, "words")
    found = words.join(near_words(words), "word", "left")
    best_n = -F.col("best.minus")
    common = (best_n > 0) & (best_n >= factor * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.word")).alias("form"), F.when(common, best_n).alias("form_n"))
    found = materialize(found, "found")
    up = found.where("form is not null").select("word", F.col("form").alias("root"))  # n grows by the factor, so ways are short
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = materialize(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    return found.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents"), least=6).select(misspelt(F.col("id"), F.col("run")).alias("word"))
    words = found.where(F.char_length("word") >= 6).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return spelling_groups(words)
