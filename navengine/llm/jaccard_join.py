"""Exact n-gram Jaccard self-join with PartEnum signatures.

A document is the set of its distinct word n-grams. For two sets of sizes a, b
with Jaccard similarity of at least t, the symmetric difference is at most
(a + b) * (1 - t) / (1 + t). Sizes are cut into bands; in a band that bound is
the same number K for all pairs, so when the feature domain is partitioned into
m > K parts, at most K parts differ between two similar sets and all other
parts agree. Every set emits one signature for each non-empty part (the subsets
of the partitions that are enumerated are single parts, the first level of
PartEnum), so similar sets of a band share a signature.

What makes this exact and safe with skew:

* A set is *strong* in a partitioning if it has more than K + slack non-empty
  parts. A set that is not strong draws another partitioning as well, until it is;
  a similar pair meets in the partitioning where the first of the two is strong,
  in slack + 1 parts at least. Sets that never become strong emit their single
  features as well, and so meet each other.
* Equal sets are one class; only classes emit signatures.
* A class stays only if it shares slack + 1 signatures of one partitioning with any
  others, and if other classes that stay hold at least the share of its features
  that similarity asks for. Both hold for every similar pair; documents that merely
  share passages go here.
* Members of a bucket are compared with its smallest member first, if the two meet in several
  buckets. The components of these links settle most buckets; only pairs from different
  components are left.
* Buckets of at most ``cold`` classes give these pairs. A pair of classes that are not weak
  (a weak class has more than slack / 2 of its buckets among the larger, hot ones) is
  compared only if it meets in half of the slack + 1 buckets.
* Weak classes are held against the classes that hot buckets tie them to, directly or through
  others, in blocks of like size, and only across components. No row is made for a pair there
  unless its sketches say that it may be similar.
* A sketch has a bit for each part of a finer partition of the feature domain: the parity of the
  set's features in it. Two sets differ in at least as many features as their sketches differ in bits, so a
  pair whose sketches are too far apart is not similar; the others' features are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S = np.uint64(32)
TAG_BITS = 11  # the low bits of a signature: band * SEEDS + partitioning
SEEDS = 32  # a set of few features fails to be strong in one of them now and then, in all of them never


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M2
    return (x ^ (x >> _S)) * _M3


_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BYTE = _mix(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) * _M1 + _M2)
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=40)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    pair = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    for x in pair:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return pair


def ngram_hashes(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams (ASCII letters lower-cased, ASCII white space splits).

    A word's hash is a polynomial in its bytes, taken for all words at once from running sums.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(max(4096, 1 << len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    w = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h + w[i : len(w) - k + 1 + i] * _M1)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def fingerprint(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


@lru_cache(maxsize=8)
def bands(percent: int, ratio: float = 1.6) -> list[tuple[int, int, int, int]]:
    """(smallest size, K, slack, m) of each band; the largest set may have 2**31 features."""
    out, lo = [], 1
    while lo < 1 << 31:
        hi = max(lo, int(lo * ratio))
        # A similar pair must lie in one band or in neighbours.
        k = 2 * hi * (100 - percent) // (100 + percent)
        slack = max(2, round(0.1 * lo)) if lo > 8 else 0
        m, need = k + 1, k + 1 + slack
        least = max(1, lo * percent // 100)  # the smallest set that emits here
        while k and m * (1 - (1 - 1 / m) ** least) < need + 0.4 * m**0.5 and m < 8 * need:
            m += max(1, m // 50)
        out.append((lo, k, slack, m))
        lo = hi + 1
    return out


def signatures(h: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """int64 signatures of a set, for its own band and, where a partner may be larger, the next."""
    n, table_ = len(h), bands(percent)
    own = next(i for i in range(len(table_) - 1, -1, -1) if table_[i][0] <= n)
    val = _mix(h ^ _M3)
    for band in (own, own + 1):
        if band > own and 100 * n < percent * table_[band][0]:
            return
        lo, k, slack, m = table_[band]
        if not k:
            continue  # only equal sets are similar here
        for seed in range(SEEDS):
            part = ((_mix(h + np.uint64((seed * 77 + band + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> _S) * np.uint64(m)) >> _S
            order = np.argsort(part.astype(np.uint32), kind="stable")
            p = part[order]
            starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            total = np.add.reduceat(val[order], starts)
            tag = np.uint64(band * SEEDS + seed)
            sig = _mix(total + _mix(p[starts] * _M1 + tag + np.uint64(1)))
            yield ((sig >> np.uint64(TAG_BITS) << np.uint64(TAG_BITS)) | tag).view(np.int64)
            if len(starts) >= k + 1 + slack:
                break
        else:
            yield single_features(h, band)


def single_features(h: np.ndarray, band: int) -> np.ndarray:
    """A signature for each feature, of sets that are strong in no partitioning: two similar ones share most of them."""
    tag = np.uint64(band * SEEDS + SEEDS - 1)
    return ((_mix(h + _M2 * (tag + np.uint64(1))) >> np.uint64(TAG_BITS) << np.uint64(TAG_BITS)) | tag).view(np.int64)


def sketch(h: np.ndarray) -> bytes:
    """Parities of the number of features in each of 4 to 8 parts a feature (a power of two, 256 at least)."""
    parts = max(256, 1 << (4 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Sketches (the last axis) over fewer parts."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def _batches(columns: list[np.ndarray | list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, fp, n_shingles, key) of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes = [], []
            for t in b.column("text"):
                h = ngram_hashes(t.as_py(), n)
                fps.append(fingerprint(h))
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), b.column("key")], names=["doc_id", "fp", "n_shingles", "key"])

    return docs.select("doc_id", "text", "key").mapInArrow(run, f"doc_id {id_type}, fp bigint, n_shingles bigint, key bigint")


def _signature_rows(docs: DataFrame, n: int, percent: int, most: int = 400_000) -> DataFrame:
    """(sig, fp); copies of a text within a task emit once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sigs, fps, rows = [], [], 0
            for t in b.column("text"):
                h = ngram_hashes(t.as_py(), n)
                if not len(h) or (fp := fingerprint(h)) in seen:
                    continue
                if len(seen) < 4_000_000:  # a memory bound; beyond it, a copy merely emits again
                    seen.add(fp)
                for s in signatures(h, percent):
                    sigs.append(s)
                    fps.append(np.full(len(s), fp, np.int64))
                    rows += len(s)
                if rows >= most:
                    yield _batches([np.concatenate(sigs), np.concatenate(fps)], ["sig", "fp"], [pa.int64()] * 2)
                    sigs, fps, rows = [], [], 0
            if rows:
                yield _batches([np.concatenate(sigs), np.concatenate(fps)], ["sig", "fp"], [pa.int64()] * 2)

    return docs.select("text").mapInArrow(run, "sig bigint, fp bigint")


def _buckets(rows: DataFrame) -> DataFrame:
    """(sig, fp) of the signatures that two classes or more share.

    Rows come sorted by (sig, fp) within their partition and stream through; only
    the last row waits until it is known whether another class has its signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, fp, shared = np.empty(0, np.int64), np.empty(0, np.int64), False  # of the last row, and whether rows before have its signature
        for b in batches:
            s, f = np.concatenate((sig, b.column(0).to_numpy())), np.concatenate((fp, b.column(1).to_numpy()))
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (f[1:] != f[:-1])
            s, f = s[new], f[new]
            if not len(s):
                continue
            same = s[1:] == s[:-1]
            before, after = np.concatenate(([shared], same)), np.concatenate((same, [False]))
            keep = (before | after)[:-1]
            if keep.any():
                yield _batches([s[:-1][keep], f[:-1][keep]], ["sig", "fp"], [pa.int64()] * 2)
            sig, fp, shared = s[-1:], f[-1:], bool(before[-1])
        if shared:
            yield _batches([sig, fp], ["sig", "fp"], [pa.int64()] * 2)

    return rows.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(run, "sig bigint, fp bigint")


def _cold_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y), x < y: of (sig, fp, comp) of cold buckets, the pairs of different components that meet often enough to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] = []
        done: list[np.ndarray] = []

        def pairs(s, f, c):
            i, j = np.nonzero(np.triu(c[:, None] != c[None, :], 1))
            if len(i):
                band = np.full(len(i), (s[0] & ((1 << TAG_BITS) - 1)) // SEEDS)
                done.append(np.stack((np.minimum(f[i], f[j]), np.maximum(f[i], f[j]), band)))

        def flush():
            p = np.concatenate(done, axis=1)
            done.clear()
            return _batches(list(p), ["x", "y", "band"], [pa.int64()] * 3)

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if carry:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            s = cols[0]
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, int)
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                pairs(*(x[i:j] for x in cols))
            carry = [x[starts[-1] :] for x in cols] if len(s) else carry
            if done:
                yield flush()
        if carry and len(carry[0]):
            pairs(*carry)
        if done:
            yield flush()

    met = rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "x bigint, y bigint, band bigint")
    need = F.array(*[F.lit(b[2] + 1 - b[2] // 2) for b in bands(percent)])
    met = met.groupBy("x", "y", "band").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= F.get(need, F.col("band").cast("int")))
    return met.select("x", "y").distinct()


def _sets(docs: DataFrame, reps: DataFrame, n: int, broadcast_rows: int) -> DataFrame:
    """(fp, n, feats, sketch) of the classes in ``reps`` (fp, doc_id, key), read again from one document of each."""
    needed = reps.select(F.col("doc_id").alias("__nav_id"), F.col("key").alias("__nav_key"), F.col("fp").alias("__nav_fp"))
    small = needed.count() <= broadcast_rows  # thirty bytes a row; larger sides are shuffled
    same = F.col("doc_id").eqNullSafe(F.col("__nav_id")) & (F.col("key") == F.col("__nav_key"))
    picked = docs.join(F.broadcast(needed) if small else needed, same).select("__nav_fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, feats, sketches = [], [], [], []
            for want, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = ngram_hashes(t.as_py(), n)
                if fingerprint(h) == want:
                    fps.append(want)
                    sizes.append(len(h))
                    feats.append(h.tobytes())
                    sketches.append(sketch(h))
            yield _batches([fps, sizes, feats, sketches], ["fp", "n", "feats", "sketch"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return picked.mapInArrow(run, "fp bigint, n bigint, feats binary, sketch binary").dropDuplicates(["fp"])


def _shared_enough(sets: DataFrame, percent: int) -> DataFrame:
    """(fp) of the sets of which at least ``percent`` in a hundred features are in another set too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            if h:
                yield _batches([np.concatenate(h), np.repeat(b.column(0).to_numpy(), [len(x) for x in h])], ["feat", "fp"], [pa.int64()] * 2)

    features = sets.select("fp", "feats").mapInArrow(run, "feat bigint, fp bigint")
    alone = features.groupBy("feat").agg(F.count(F.lit(1)).alias("k"), F.min("fp").alias("fp")).where("k = 1").groupBy("fp").agg(F.count(F.lit(1)).alias("alone"))
    return sets.select("fp", "n").join(alone, "fp", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).select("fp")


def most_apart(size: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    """Times 100 + percent: the most features in which two similar sets with ``size`` features together differ."""
    return size * (100 - percent)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sizes and sketches allow that they are similar."""
    right = sets.select(F.col("fp").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    left = sets.select(F.col("fp").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = most_apart(b.column(2).to_numpy() + b.column(3).to_numpy(), percent)
            keep = np.zeros(b.num_rows, bool)
            for i, (sx, sy) in enumerate(zip(b.column(4), b.column(5), strict=True)):
                u, v = np.frombuffer(sx.as_buffer(), np.uint64), np.frombuffer(sy.as_buffer(), np.uint64)
                size = min(len(u), len(v))
                keep[i] = int(np.bitwise_count(folded(u, size) ^ folded(v, size)).sum()) * (100 + percent) <= most[i]
            yield b.select(["x", "y"]).filter(pa.array(keep))

    joined = pairs.join(right, "y").join(left, "x").where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    return joined.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(run, "x bigint, y bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (x, y) whose sets are similar enough."""
    left = sets.select(F.col("fp").alias("x"), F.col("feats").alias("fx"))
    right = sets.select(F.col("fp").alias("y"), F.col("feats").alias("fy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (fx, fy) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                u, v = np.frombuffer(fx.as_buffer(), np.uint64), np.frombuffer(fy.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(u) + len(v) - both)
            yield b.select(["x", "y"]).filter(pa.array(keep)).rename_columns(["a", "b"])

    return pairs.join(right, "y").join(left, "x").select("x", "y", "fx", "fy").mapInArrow(run, "a bigint, b bigint")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The links among the pairs."""
    near = materialize(_near(pairs, sets, percent), f"{name}_near")
    return materialize(_verified(near, sets, percent), f"{name}_links")


def _blocks(hot: DataFrame, block_bytes: int = 1 << 22) -> DataFrame:
    """``hot`` (band, fp, n, cluster, sketch, ...) with the number of a block of like sizes within (band, cluster).

    Sizes with very many classes are cut by a hash as well, so that no block grows with the input.
    """
    rows_in = F.floor(F.greatest(F.lit(64), F.least(F.lit(4096), block_bytes / F.octet_length("sketch"))))
    per_size = hot.groupBy("band", "cluster", "n").agg(F.count(F.lit(1)).alias("k"), F.min(rows_in).alias("most"))
    upto = F.sum("k").over(Window.partitionBy("band", "cluster").orderBy("n"))
    cut = per_size.withColumn("lo", F.floor((upto - F.col("k")) / F.col("most"))).withColumn("hi", F.floor((upto - 1) / F.col("most"))).select("band", "cluster", "n", "lo", "hi")
    return hot.join(cut, ["band", "cluster", "n"]).withColumn("block", F.col("lo") + F.pmod(F.xxhash64("fp"), F.col("hi") - F.col("lo") + 1)).drop("lo", "hi")


def _hot_blocks(left: DataFrame, weak: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes of hot buckets, dealt to blocks, and the pairs of blocks (band, cluster, i, j) that must meet.

    left: (sig, fp, rep, hot). Only classes of the same band and cluster meet; a cluster is what hot buckets connect.
    """
    hot = left.where("hot")
    cluster = connected_components(hot.select("fp", "rep").distinct(), "fp", "rep").select(F.col("node").alias("fp"), F.col("label").alias("cluster"))
    rows = hot.select(_band().alias("band"), "fp").distinct().join(cluster, "fp").join(weak, "fp", "left").withColumn("weak", F.coalesce("weak", F.lit(False)))
    dealt = materialize(_blocks(rows.join(sets.select("fp", "n", "sketch"), "fp")), "dealt")
    blocks = materialize(dealt.groupBy("band", "cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("weak").alias("any")), "blocks")
    one, two = blocks.alias("a"), blocks.alias("b")
    near = (F.col("a.band") == F.col("b.band")) & (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") <= F.col("b.block")) & (F.col("a.any") | F.col("b.any"))
    near &= (100 * F.col("a.most") >= percent * F.col("b.least")) & (100 * F.col("b.most") >= percent * F.col("a.least"))
    return dealt, materialize(one.join(two, near).select("a.band", "a.cluster", F.col("a.block").alias("i"), F.col("b.block").alias("j")), "meet")


def _hot_pairs(dealt: DataFrame, meet: DataFrame, comp: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(x, y), x < y: the pairs with a weak member and of different components whose sketches are close.

    nearest: of each class in a block only the closest pair.
    """
    dealt = dealt.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("label", "fp")).drop("label")
    key = ["band", "cluster"]
    names = [*key, "i", "j", "fp", "comp", "weak", "n", "sketch"]
    sides = [meet.join(dealt.withColumnRenamed("block", c), [*key, c]).select(*[F.col(x).alias(x) for x in names]) for c in ("i", "j")]

    def compare(_, a: pa.Table, b: pa.Table) -> pa.Table:
        def arrays(t: pa.Table, size: int):
            words = [folded(np.frombuffer(x.as_buffer(), np.uint64), size) for x in t.column("sketch")]
            return *(t.column(c).to_numpy() for c in ("fp", "comp", "weak", "n")), np.ascontiguousarray(np.array(words, np.uint64).reshape(-1, size).T)

        size = min(pc.min(pc.binary_length(t.column("sketch"))).as_py() for t in (a, b) if t.num_rows) // 8 if a.num_rows and b.num_rows else 1
        (fa, ca, wa, na, va), (fb, cb, wb, nb, vb) = arrays(a, size), arrays(b, size)
        xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for mine, other in ((np.flatnonzero(wa), np.arange(len(fb))), (np.flatnonzero(~wa), np.flatnonzero(wb))):
            vo = np.ascontiguousarray(vb[:, other])
            for lo in range(0, len(mine) if len(other) else 0, 64):
                s = mine[lo : lo + 64]
                apart = np.zeros((len(s), len(other)), np.uint32)
                for x, y in zip(va[:, s], vo, strict=True):
                    apart += np.bitwise_count(x[:, None] ^ y)
                good = (apart * np.int64(100 + percent) <= most_apart(na[s, None] + nb[other], percent)) & (ca[s, None] != cb[other])
                if nearest:
                    apart[~good] = np.iinfo(np.uint32).max
                    only = np.zeros_like(good)
                    only[np.arange(len(s)), apart.argmin(axis=1)] = True
                    only[apart.argmin(axis=0), np.arange(len(other))] = True
                    good &= only
                i, j = np.nonzero(good)
                xs.append(fa[s[i]])
                ys.append(fb[other[j]])
        x, y = np.concatenate(xs), np.concatenate(ys)
        return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y)})

    return sides[0].groupBy(*key, "i", "j").cogroup(sides[1].groupBy(*key, "i", "j")).applyInArrow(compare, "x bigint, y bigint").distinct()


def _band() -> Column:
    return F.floor(F.col("sig").bitwiseAND(F.lit((1 << TAG_BITS) - 1)) / SEEDS).cast("int")


def _met(buckets: DataFrame, percent: int) -> DataFrame:
    """(fp) of the classes that share slack + 1 signatures of a partitioning with others."""
    need = F.array(*[F.lit(b[2] + 1) for b in bands(percent)])
    tag = F.col("sig").bitwiseAND(F.lit((1 << TAG_BITS) - 1)).cast("int")
    met = buckets.groupBy("fp", tag.alias("tag")).agg(F.count(F.lit(1)).alias("k"))
    return met.where(F.col("k") >= F.get(need, F.floor(F.col("tag") / SEEDS).cast("int"))).select("fp").distinct()


def _kept(buckets: DataFrame, alive: DataFrame, cold: int, broadcast_rows: int) -> DataFrame:
    """(sig, fp, rep, hot) of the classes in ``alive``, of the buckets in which two of them are left."""
    small = alive.count() <= broadcast_rows  # eight bytes a row
    mine = materialize(buckets.select("sig", "fp").join(F.broadcast(alive) if small else alive, "fp", "left_semi"), "mine")
    size = mine.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.min("fp").alias("rep")).where("k > 1").select("sig", "rep", (F.col("k") > cold).alias("hot"))
    return mine.join(size, "sig").select("sig", "fp", "rep", "hot")


def _open(buckets: DataFrame, comp: DataFrame, cold: int) -> DataFrame:
    """(sig, fp, rep, hot, comp) of the buckets with members of several components."""
    known = materialize(buckets.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("sig", "fp", "rep", "hot", F.coalesce("label", "fp").alias("comp")), "members")
    open_ = known.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    return materialize(known.join(open_, "sig", "left_semi"), "open")


def _weak(buckets: DataFrame, percent: int) -> DataFrame:
    """(fp) of the classes with more hot buckets in a partitioning than half its slack."""
    mask = (1 << TAG_BITS) - 1
    slack = F.array(*[F.lit(b[2] // 2) for b in bands(percent)])
    tag = F.col("sig").bitwiseAND(F.lit(mask))
    hot = buckets.where("hot").groupBy("fp", tag.alias("tag")).agg(F.count(F.lit(1)).alias("k"))
    return hot.where(F.col("k") > F.get(slack, F.floor(F.col("tag") / SEEDS).cast("int"))).select("fp").distinct()


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, cold: int = 32, joins: int = 2, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Link every two documents whose word n-gram sets have a Jaccard similarity of at least ``percent``/100.

    Returns one row per input row: doc_id, n_shingles (the set's size), component_id
    (the smallest id reachable by links, its own included), class_id (equal
    for equal sets). Null or blank texts have no features, link with nothing
    and are their own component. Repeated rows and equal texts are one class. Rows with a
    null id take part; the component of a class that has no id at all is null. Other
    columns are ignored. An empty table gives an empty result.
    """
    if not 50 <= percent <= 99:
        raise ValueError("percent must be from 50 to 99")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    of_doc = materialize(_fingerprints(docs, n), "fingerprints")
    first = F.coalesce(F.min_by("key", "doc_id"), F.min("key"))
    classes = of_doc.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), first.alias("key"))
    buckets = materialize(_buckets(_signature_rows(docs, n, percent)), "buckets")
    sets = materialize(_sets(docs, materialize(classes.join(_met(buckets, percent), "fp", "left_semi"), "met"), n, broadcast_rows), "sets")
    alive = materialize(_shared_enough(sets, percent), "alive")
    buckets = materialize(_kept(buckets, alive, cold, broadcast_rows), "kept")
    # A first choice of pairs; any choice is right, as what it leaves open is looked at again below.
    stars = buckets.where("fp <> rep").groupBy(F.col("rep").alias("x"), F.col("fp").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    links = _compared(stars.where("k >= 3").select("x", "y"), sets, percent, "stars")
    comp = connected_components(links)
    left = _open(buckets, comp, cold)
    weak = materialize(_weak(left, percent), "weak").withColumn("weak", F.lit(True))
    any_weak = not weak.isEmpty()
    if any_weak:
        dealt, meet = _hot_blocks(left, weak, sets, percent)
        # Large groups of near copies first grow together along their closest pairs; else they would give all of theirs.
        for _ in range(joins):
            more = _compared(_hot_pairs(dealt, meet, comp, percent, True), sets, percent, "joins")
            if more.isEmpty():
                break
            comp = connected_components(more, known=comp)
    rest = _cold_pairs(left.where("not hot").drop("comp").join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("sig", "fp", F.coalesce("label", "fp").alias("comp")), percent)
    if any_weak:
        rest = rest.unionByName(_hot_pairs(dealt, meet, comp, percent, False)).distinct()
    more = _compared(rest, sets, percent, "rest")
    if not more.isEmpty():
        comp = connected_components(more, known=comp)
    of_class = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("label", "fp").alias("label"))
    lowest = of_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = of_class.join(lowest, "label").select("fp", "component_id")
    return of_doc.join(named, "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("fp").alias("class_id")
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
