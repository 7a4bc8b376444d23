"""The split and the bounded training sample that the two text classifiers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_per_class(rows: DataFrame, class_col: str, id_col: str, most: int, most_broadcast: int = 100_000) -> DataFrame:
    """About ``most`` rows of each class, by a hash of their ids; all rows of smaller classes.

    The bound on the training sample of a classifier. The choice depends on ids
    alone, so it is the same however the table is partitioned. Rows without a class go.
    The classes' counts are broadcast, up to ``most_broadcast`` classes.
    """
    counts = materialize(rows.where(F.col(class_col).isNotNull()).groupBy(class_col).agg(F.count(F.lit(1)).alias("__nav_n")), "classes")
    counts = F.broadcast(counts) if counts.count() <= most_broadcast else counts
    drawn = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) * F.col("__nav_n").cast("double") < float(most << 30)
    return rows.join(counts, class_col).where(drawn).select(*rows.columns)
