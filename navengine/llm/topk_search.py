"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components are integer weights, and each dimension is a term whose postings are
the candidates with their weights. Candidates stay in the partitions they are read in. The queries are written to the shared folder in blocks of
bounded size, and every task scores its candidates, a block at a time, for one block of queries after
another, term by term: every query row with a weight in the term scatters weighted postings into its dense array of scores. The
k best of a block for every query are found by partition selection, and these lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, table


def weights(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component as longs; an error for one that no long holds."""
    scaled = lambda x: F.floor(x.cast("double") * scale)
    huge = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= float(1 << 63))
    return F.when(huge, F.raise_error("a component is too large for a 64-bit weight")).otherwise(F.transform(vector, lambda x: scaled(x).cast("long")))


def usable(vector: Column) -> Column:
    """Not null, and no component null or non-finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates); rows of ``postings`` are terms. OverflowError if a score needs more than 64 bits."""
    largest = [max((abs(int(f(x))) for f in (np.min, np.max)), default=0) if x.size else 0 for x in (queries, postings)]
    exact = largest[0] * largest[1] * len(postings) >= 1 << 63  # then in Python's integers
    if exact:
        queries, postings = queries.astype(object), postings.astype(object)
    scores = np.zeros((len(queries), postings.shape[1]), object if exact else np.int64)
    for term, posting in enumerate(postings):
        w = queries[:, term]
        rows = np.flatnonzero(w)
        if len(rows) == len(w):
            scores += w[:, None] * posting
        elif len(rows):
            scores[rows] += w[rows, None] * posting
    return scores.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of one row: highest score, then smallest id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``column`` as a matrix; shorter vectors end in zeros, longer ones lose what no query has."""
    out = np.zeros((len(column), dims), np.int64)
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dims)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        out[i, : min(dims, b - a)] = flat[a : min(b, a + dims)]
    return out


def best_of_blocks(ids: np.ndarray, q: np.ndarray, names: np.ndarray, candidates: np.ndarray, k: int, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score): the k best of a block of candidates for each of a block of queries."""
    kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
    for lo in range(0, len(names), batch):
        other = names[lo : lo + batch]
        scores = accumulate(q, np.ascontiguousarray(candidates[lo : lo + batch].T))
        for i, own in enumerate(ids):
            s, c = scores[i], other
            if (c == own).any():
                s, c = s[c != own], c[c != own]
            at = best(s, c, k)
            s, c = np.concatenate((kept[i][0], s[at])), np.concatenate((kept[i][1], c[at]))
            at = best(s, c, k)
            kept[i] = s[at], c[at]
    return np.repeat(ids, [len(s) for s, _ in kept]), np.concatenate([c for _, c in kept]), np.concatenate([s for s, _ in kept])


def _blocks(folder: str) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
    """(ids, weights) of each written block of queries."""
    from pyarrow import fs as pafs
    from pyarrow import parquet

    fs, path = filesystem(folder)
    for f in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".parquet")):
        t = parquet.ParquetFile(f, filesystem=fs).read(columns=["vec_id", "w"])
        if t.num_rows:
            yield t.column("vec_id").to_numpy(), t.column("w").combine_chunks()


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, query_rows: int = 4096, block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` candidates of the highest inner product of weights.

    A query's own id is no candidate; ties go to the smaller id. Rows with a null id, and vectors
    that are null or hold null or non-finite components take no part. Large components are summed
    exactly; a weight or a score that no 64-bit integer holds is an error.
    Vectors of different lengths meet as if the shorter ended in zeros. A repeated query
    id counts once (its smallest vector); a repeated candidate takes part as often as it occurs. Blocks have about
    ``query_rows`` queries and ``block_bytes`` of candidates; no vector of a candidate is shuffled, and nothing is broadcast or collected. Empty
    tables give no rows.
    """
    spark = vectors.sparkSession
    cols = F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")
    c = vectors.select(*cols).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", weights(F.col("v"), scale).alias("w"))
    q = queries.select(*cols).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", weights(F.col("v"), scale).alias("w"))
    asked = queries.agg(F.count(F.lit(1))).first()[0]
    folder = f"{shared_dir(spark)}/queries"
    q = q.groupBy("vec_id").agg(F.min("w").alias("w")).repartition(max(1, -(-asked // query_rows)), "vec_id")
    q.write.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def scored() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            names, w = t.column("vec_id").to_numpy(), t.column("w").combine_chunks()
            for ids, asked in _blocks(folder):
                dims = int(np.diff(asked.offsets.to_numpy()).max(initial=0))
                found = best_of_blocks(ids, _matrix(asked, dims), names, _matrix(w, dims), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

        waiting = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                waiting += b.nbytes
            if waiting >= block_bytes:
                yield from scored()
                held, waiting = [], 0
        if held:
            yield from scored()

    merged = c.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(v, v.where(F.col("vec_id") % 100 == 0))


OP8_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as w from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id as vec_id,
           cast(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 10
"""
