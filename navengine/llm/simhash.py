"""Near duplicates by SimHash: fingerprints within a few bits of each other, compared in bit slices.

Fingerprints that differ in at most ``radius`` bits agree in some choice of blocks of bits, so only those that share a
choice are compared. In a task the fingerprints of many such buckets stand in lanes: bit plane j holds bit j of all
of them. Moving the planes by s lanes sets every fingerprint against the s-th after it at once; the differing bits are
added up by carry-save adders on whole words, and words whose 64 lanes all exceed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components

BITS = 64


def simhash(text: str | None, n: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    """The fingerprint: bit j is 1 if it is set in the XXH64 of over half the word n-grams, repeats included.

    Words are split at ASCII white space, A to Z count as a to z; a text of fewer words is one n-gram, and one without words has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return 0
    k = min(n, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_, spans = xxhash.xxh64_intdigest, list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(spans), chunk):
        h = np.array([hash_(line[a:b], seed) for a, b in spans[lo : lo + chunk]], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((2 * counts > len(spans)) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def planes(fingerprints: np.ndarray, spare: int) -> np.ndarray:
    """(64, words): word w of plane j has bit j of fingerprints 64 * w and on; ``spare`` lanes of zeros follow."""
    lanes = -(-(len(fingerprints) + spare) // 64) * 64 + 64
    bits = np.zeros((BITS, lanes), np.uint8)
    bits[:, : len(fingerprints)] = np.unpackbits(fingerprints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: sum and carry of three words of bits."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


class Counters:
    """How many bits were added in each lane, and in ``over`` the lanes with more than ``radius``.

    They start so that a count beyond the radius carries out of the highest level. A level adds its two next summands at once.
    """

    def __init__(self, words: int, radius: int):
        self.levels = radius.bit_length()
        start = (1 << self.levels) - 1 - radius
        self.sums = [np.full(words, ~np.uint64(0) if start >> i & 1 else 0, np.uint64) for i in range(self.levels)]
        self.waiting: list[np.ndarray | None] = [None] * self.levels
        self.over = np.zeros(words, np.uint64)

    def add(self, x: np.ndarray, level: int = 0) -> None:
        if level == self.levels:
            self.over |= x
        elif (other := self.waiting[level]) is None:
            self.waiting[level] = x
        else:
            self.waiting[level] = None
            self.sums[level], carry = _full(self.sums[level], other, x)
            self.add(carry, level + 1)

    def settle(self) -> np.ndarray:
        """Adds what waits; the lanes within the radius."""
        for i in range(self.levels):
            if self.waiting[i] is not None:
                self.add(np.zeros_like(self.over), i)
        return ~self.over

    def keep(self, at: np.ndarray) -> None:
        self.sums, self.over = [x[at] for x in self.sums], self.over[at]
        self.waiting = [None if x is None else x[at] for x in self.waiting]


def near_lanes(p: np.ndarray, lanes: int, shift: int, radius: int) -> np.ndarray:
    """The first ``lanes`` lanes whose fingerprint is within the radius of the one ``shift`` lanes after it."""
    at = np.arange(-(-lanes // 64))
    word, bit = divmod(shift, 64)
    count = Counters(len(at), radius)
    for j in range(BITS):
        plane = p[j * 37 % BITS]  # neighbouring bits, which a bucket may share, come at different times
        other = plane[at + word]
        if bit:
            other = other >> np.uint64(bit) | plane[at + word + 1] << np.uint64(64 - bit)
        count.add(plane[at] ^ other)
        if j % 8 == 7:
            open_ = count.settle() != 0
            if not open_.all():
                at = at[open_]
                count.keep(open_)
                if not len(at):
                    return at
    bits = np.unpackbits(count.settle().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64)
    row, col = np.nonzero(bits)
    found = at[row] * 64 + col
    return found[found < lanes]


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        parent[x] = parent[up]
        x = up


def links_of_buckets(keys: list[np.ndarray], fingerprints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, another) that tie together what is linked inside a bucket: fewer rows than fingerprints, however many pairs there are."""
    order = np.lexsort(keys)
    turns = np.concatenate(([True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)))
    sizes = np.diff(np.append(np.flatnonzero(turns), len(order)))
    of = np.repeat(np.arange(len(sizes)), sizes)
    large = np.lexsort((of, -sizes[of]))  # large buckets first: a shift needs only the first lanes
    order, width = order[large], sizes[of][large]
    fp = fingerprints[order]
    ends = np.concatenate(([0], np.cumsum(np.sort(sizes)[::-1])))
    end = np.repeat(ends[1:], np.sort(sizes)[::-1])
    p = planes(fp, int(width[0]))
    parent = np.arange(len(fp))
    shift, lanes = 1, int((width > 1).sum())
    while lanes:
        a = near_lanes(p, lanes, shift, radius)
        a = a[a + shift < end[a]]
        b = a + shift
        while len(a):
            a, b = _roots(parent, a), _roots(parent, b)
            open_ = a != b
            a, b = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(parent, b, a)
        shift += 1
        lanes = int(np.searchsorted(-width, -shift, "left"))  # widths fall
    root = _roots(parent, np.arange(len(fp)))
    tied = np.flatnonzero(root != np.arange(len(fp)))
    return fp[tied], fp[root[tied]]


def choices(blocks: int, radius: int) -> list[int]:
    """Masks of blocks - radius of ``blocks`` blocks of bits: fingerprints within the radius agree under one of them."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _ties(fps: DataFrame, n: int, radius: int, bucket_rows: int, batch: int = 1 << 18) -> DataFrame:
    """(a, b): fingerprints tied inside a bucket. fps: ``n`` distinct fingerprints."""
    blocks = radius + 1
    while n >> (BITS * (blocks - radius) // blocks) > bucket_rows // 16 and comb(blocks + 1, radius) <= 64:
        blocks += 1
    masks = [m - (1 << 64) if m >> 63 else m for m in choices(blocks, radius)]
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(kinds).alias("b")).select("b.kind", "b.key", "fp")
    sizes = materialize(rows.groupBy("kind", "key").count().where(F.col("count") > bucket_rows), "large_buckets")  # at most kinds * n / bucket_rows rows
    if not sizes.isEmpty():  # every two parts of a large bucket meet in a bucket of their own
        parts = F.ceil(F.col("count") * 2 / bucket_rows).cast("int")
        known = sizes.select("kind", "key", parts.alias("parts"))
        known = F.broadcast(known) if known.count() <= 1_000_000 else known
        rows = rows.join(known, ["kind", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumns({"g": F.least("own", "other"), "h": F.greatest("own", "other")})
    else:
        rows = rows.withColumns({"g": F.lit(0), "h": F.lit(0)})
    rows = rows.select("kind", "key", "g", "h", "fp").repartition("kind", "key", "g", "h").sortWithinPartitions("kind", "key", "g", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links_of_buckets(cols[:4], cols[4].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        def joined() -> list[np.ndarray]:
            return [np.ascontiguousarray(np.concatenate(x)) for x in zip(*held, strict=True)]

        waiting = 0
        for x in batches:
            held.append([x.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            waiting += x.num_rows
            if waiting >= batch:
                cols = joined()
                last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))
                if len(last):  # the last bucket may go on
                    cut = int(last[-1]) + 1
                    yield flush([c[:cut] for c in cols])
                    cols = [c[cut:] for c in cols]
                held, waiting = [cols], 0
        if held and sum(len(x[4]) for x in held):
            yield flush(joined())

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 3, bucket_rows: int = 1 << 16, broadcast_rows: int = 1_000_000) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id reachable over fingerprints that differ in at most ``radius`` bits.

    One row for each row of ``docs``, also for repeated ids and texts. A null, empty or blank text has
    fingerprint 0 and is linked like any other. A row with a null id stays and takes part in links; the smallest id is that of
    the others, and null if there is none. Other columns are not read. An empty table gives an empty result.
    Copies are compared once. Buckets above ``bucket_rows`` fingerprints are split into parts that meet pairwise, each pair in a
    task of its own; no pair of documents becomes a row.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, n) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    hashed = materialize(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {id_type}, fp bigint"), "fingerprints")
    fps = materialize(hashed.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    of = connected_components(_ties(fps.select("fp"), fps.count(), radius, bucket_rows), task_rows=1_000_000)
    linked = of.join(fps, F.col("node") == F.col("fp"))
    roots = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    linked = linked.join(roots, "label").select("fp", "component_id")
    copies = fps.where("n > 1").join(of, F.col("node") == F.col("fp"), "left_anti").select("fp", F.col("low").alias("component_id"))
    known = materialize(linked.unionByName(copies), "known")
    known = F.broadcast(known) if known.count() <= broadcast_rows else known  # sixteen bytes a row and more for ids that are strings
    found = hashed.join(known.withColumn("__nav_known", F.lit(True)), "fp", "left")
    component = F.when(F.col("__nav_known"), F.col("component_id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
