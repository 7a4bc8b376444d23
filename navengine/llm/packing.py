"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids; ids longer than a sequence are cut. The pieces are
dealt to shards of bounded size. Each shard is evolved on several islands: a
solution is a set of bins; crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold the same pieces, and puts displaced pieces back by
best fit. Between rounds every island sends its best solution to its
neighbour. Pieces in poorly filled bins of all shards meet again at a next level.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

END = np.array([0], "<u4").tobytes()


class Encoder(dict):
    """Text to the bytes of its ids (little-endian, 32 bits), with a bounded memory of units.

    A unit is a run without white space with one space before it, or white space
    as the vocabulary's own pattern parts it; ids never cross units. tiktoken
    reads the same byte-level vocabulary as the JSON file, several times faster;
    texts with a special token's string go through the JSON file whole.
    """

    # Where Python's and the vocabulary's white space are not the same.
    ODD = re.compile("[\x1c-\x1f]")
    UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s")
    TAIL = re.compile(r"( ?[^\W\d_]+)([.,;:!?]+)")

    def __init__(self, ranks_path: str, pattern: str, json_path: str, most: int = 500_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most
        self.full = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.plain(text), "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        m = self.TAIL.fullmatch(unit)
        out = self[m[1]] + self[m[2]] if m else self.whole(unit)
        if len(unit) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[unit] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.UNIT.findall(text)))


@lru_cache(maxsize=2)
def _encoder(path: str | None, pattern: str | None, json_path: str | None) -> Encoder:
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, json_path or public_tokenizers.path("byte_bpe_50k.json"))


def pieces(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, json_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of each piece; all but a document's first are ``size`` long."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, salt = _encoder(ranks_path, pattern, json_path), 0
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = encoder.encode(t.as_py()) + END
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(ids[4 * x : 4 * y]))
            ints = [pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]
            salts = pa.array(range(salt, salt + len(at)), pa.int64())
            salt += len(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *ints, salts], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
        encoder.clear()  # workers outlive their tasks

    return docs.mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint")


Bins = list[list[int]]


def best_fit(items: list[int], lens: list[int], size: int, bins: Bins) -> Bins:
    """Put the items, in their order, each into the bin it fills best; adds to ``bins``."""
    room = sorted((size - sum(lens[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (lens[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (size - lens[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            insort(room, (left - lens[i], k))
    return bins


def fitness(bins: Bins, lens: list[int], size: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones; lower is better."""
    return len(bins), -sum((sum(lens[i] for i in b) / size) ** 2 for b in bins)


def crossover(a: Bins, b: Bins, lens: list[int], size: int, rng: random.Random) -> Bins:
    """A child of ``a`` with a random run of well-filled bins of ``b``."""
    full = sorted(b, key=lambda x: -sum(lens[i] for i in x))[: max(1, len(b) * 3 // 4)]
    lo = rng.randrange(len(full))
    given = [list(x) for x in full[lo : lo + max(1, len(full) // 3)]]
    have = {i for x in given for i in x}
    child, out = given, []
    for x in a:
        if have.isdisjoint(x):
            child.append(list(x))
        else:
            out += [i for i in x if i not in have]
    return best_fit(sorted(out, key=lambda i: -lens[i]), lens, size, child)


def evolve(lens: list[int], size: int, seeds: list[Bins], rng: random.Random, people: int = 6, generations: int = 8) -> Bins:
    """The best solution after some generations; at once if the count of bins cannot be lower."""
    least = -(-sum(lens) // size)
    order = sorted(range(len(lens)), key=lambda i: -lens[i])
    found = [*seeds] or [best_fit(order, lens, size, [])]
    best = min(found, key=lambda s: fitness(s, lens, size))
    if len(best) <= least:
        return best
    while len(found) < people:
        noisy = sorted(order, key=lambda i: -lens[i] * rng.uniform(0.8, 1.0))
        found.append(best_fit(noisy, lens, size, []))
    for _ in range(generations):
        found.sort(key=lambda s: fitness(s, lens, size))
        if len(found[0]) <= least:
            break
        found = [*found[: people // 2], *(crossover(found[rng.randrange(people // 2)], found[rng.randrange(people)], lens, size, rng) for _ in range(people - people // 2))]
    return min(found, key=lambda s: fitness(s, lens, size))


def _flat(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(flat: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        out[k].append(i)
    return out


def _round(islands: DataFrame, size: int, number: int) -> DataFrame:
    """Each row is an island: (shard, island, lens, best, guest); evolves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = []
            for shard, island, lens, own, guest in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                rng = random.Random(shard * 1009 + island * 31 + number)
                best.append(_flat(evolve(lens, size, [_bins(x) for x in (own, guest) if x], rng), len(lens)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(best, pa.list_(pa.int32()))], names=["shard", "island", "lens", "best"])

    return islands.mapInArrow(run, "shard bigint, island int, lens array<bigint>, best array<int>")


def _level(rows: DataFrame, size: int, level: int, per_shard: int, islands: int, rounds: int) -> DataFrame:
    """``rows`` with bin (within shard), shard, offset and fill."""
    count = rows.count()
    shards = max(1, -(-count // per_shard))
    key = F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(level)), F.lit(shards))
    held = materialize(rows.withColumn("shard", key).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "doc_id", "piece", "start", "ids_crc32", "salt"))).alias("rows")), "shards")
    none = F.lit(None).cast("array<int>")
    state = held.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("rows.length").alias("lens"))
    state = state.withColumns({"best": none, "guest": none}).repartition("shard", "island")
    state = materialize(_round(state, size, 0), "islands")
    for number in range(1, rounds):
        sent = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("best").alias("guest"))
        state = materialize(_round(state.join(sent, ["shard", "island"]).select("shard", "island", "lens", "best", "guest"), size, number), "islands")
    winner = state.groupBy("shard").agg(F.min_by("best", F.struct(F.array_max("best"), "island")).alias("best"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kind = f"array<struct<length:bigint,doc_id:{id_type},piece:int,start:bigint,ids_crc32:bigint,salt:bigint>>"
    flat = held.join(winner, "shard").select("shard", F.posexplode(F.arrays_zip(F.col("rows").cast(kind).alias("row"), "best")))
    flat = flat.select("shard", "pos", "col.row.*", F.col("col.best").alias("bin"))
    from pyspark.sql import Window as W

    w = W.partitionBy("shard", "bin")
    return flat.withColumns({"offset": F.sum("length").over(w.orderBy("pos")) - F.col("length"), "fill": F.sum("length").over(w)})


def pack(docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", per_shard: int = 2048, islands: int = 2, rounds: int = 2, levels: int = 2, waste: float = 0.02, ranks_path: str | None = None, pattern: str | None = None, json_path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is one piece that holds only the end id 0. Repeated rows are packed
    as often as they occur; null ids stay null. Other columns are ignored, and an empty
    table gives no rows. Long texts are encoded whole. Ties between equal solutions go to the lower island.
    """
    cut = materialize(pieces(docs, size, id_col, text_col, ranks_path, pattern, json_path), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = cut.where(F.col("length") == size).withColumns({"sequence_id": F.monotonically_increasing_id() + F.lit(1 << 62), "offset": F.lit(0).cast("long")}).select(*names)
    rows = cut.where(F.col("length") < size)
    for level in range(levels):
        placed = materialize(_level(rows, size, level, per_shard, islands, rounds), "placed")
        last = level + 1 == levels
        done = placed if last else placed.where(F.col("fill") >= size * (1 - waste))
        number = F.shiftleft(F.lit(level).cast("long"), 58) + F.shiftleft(F.col("shard").cast("long"), 16) + F.col("bin")
        out = out.unionByName(done.withColumn("sequence_id", number).select(*names))
        if not last:
            rows = placed.where(F.col("fill") < size * (1 - waste)).select(*cut.columns)
    return out


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
