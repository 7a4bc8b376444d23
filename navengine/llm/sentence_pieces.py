"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The merges of a public model are applied by an agenda: the adjacent pair
whose joined piece has the best score is merged first, the leftmost on ties. With
dropout, each candidate that comes off the agenda is skipped at the rate, by a hash of (seed, text
of the document, place of the part, skips so far); it comes up again only if a neighbour changes. So
each occurrence of a word draws its own segmentation. Parts of many texts are merged at once, a
candidate of each in a step of array operations; what is remembered of a unit is its plain outcome.
Texts are not normalised: a space becomes U+2581, what the
vocabulary lacks becomes bytes, so that decoding gives back the text exactly.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
_UNIT = re.compile(r" *[^ ]+| +")
_BITS = (1 << 64) - 1
LONG = 48  # longer parts of a unit are merged one by one, with a heap
NONE = np.int32((1 << 31) - 1)
GONE, EDGE = -1, -2  # no symbols: merged into the left neighbour, before the first or after the last
AT_ONCE, BLOCK = 1 << 15, 1 << 18  # parts merged and units met at once


def _drawn(x: np.ndarray) -> np.ndarray:
    """A 64-bit draw for each key; a draw is the key of the next one."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    """Numbers what it is asked for; ``fresh`` are the new keys."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class _Pool:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.zeros(max(n, len(self.held)), self.held.dtype)))
        self.held[self.n : n] = values
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after the other."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def _codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Pieces:
    """A model's pieces, and a bounded memory of units."""

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = [0] * 256
        self.text: list[str | bytes] = []
        scored: list[tuple[float, int, str]] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            else:
                self.text.append(piece.replace(SPACE, " ").encode() if not (sp.is_control(i) or sp.is_unknown(i)) else b"")
                if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                    scored.append((-sp.get_score(i), i, piece))
        scored.sort()
        self.rank = {p: k for k, (_, _, p) in enumerate(scored)}  # the best score first
        self.id = {p: i for _, i, p in scored}
        # A symbol is a piece's rank; characters that are no pieces get later numbers, and the ids of their bytes.
        self.symbol = np.full(0x110000, -1, np.int64)  # of each character
        self.ids, self.first, self.count = _Pool(np.int32), _Pool(np.int64), _Pool(np.int64)  # of each symbol
        self.ids.add(np.array([i for _, i, _ in scored], np.int32))
        self.first.add(np.arange(len(scored)))
        self.count.add(np.ones(len(scored), np.int64))
        inner = sorted({c for p in self.rank if len(p) > 1 for c in p})
        for c, k in self.rank.items():
            if len(c) == 1 and c != SPACE:  # one in the text itself must not turn into a space
                self.symbol[ord(c)] = k
        if (k := self.rank.get(SPACE)) is not None:
            self.symbol[ord(" ")] = k
        self._know(np.array([ord(" " if c == SPACE else c) for c in inner], np.int64))
        single = {c: int(self.symbol[ord(" " if c == SPACE else c)]) for c in inner}
        self.char = {k: c for c, k in single.items()}  # of each symbol that long parts consist of
        symbol = {p: k for p, k in self.rank.items() if len(p) > 1} | single
        pairs = {symbol[p[:i]] << 22 | symbol[p[i:]]: k for p, k in self.rank.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol}
        self.pairs = np.array([*sorted(pairs), (1 << 62)], np.int64)
        self.joined = np.array([*(k << 6 for _, k in sorted(pairs.items())), NONE], np.int32)
        # Neighbours in no piece are never merged: a unit falls apart between them.
        self.inside = np.array(sorted({ord(x[0]) << 22 | ord(x[1]) for p in self.rank for i in range(len(p) - 1) if (x := p[i : i + 2].replace(SPACE, " "))} | {1 << 62}), np.int64)
        self.most = most
        self.rate, self.least = 0, np.empty(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.units = _Numbers()
        self.part_first, self.part_count = _Pool(np.int64), _Pool(np.int64)  # of each unit
        self.start, self.length = _Pool(np.int64), _Pool(np.int64)  # of each part, in symbols and agenda
        self.symbols, self.agenda = _Pool(np.int32), _Pool(np.int32)
        self.plain, self.plain_first, self.plain_count = _Pool(np.int32), _Pool(np.int64), _Pool(np.int64)  # ids of each part if nothing is skipped
        self.left = _Pool(np.int64)  # candidates of each part if nothing is skipped; -1: a long part

    def _know(self, points: np.ndarray) -> None:
        """Give symbols to characters that have none."""
        for c in np.unique(points[self.symbol[points] < 0]).tolist():
            ids = [self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")]
            self.symbol[c] = self.count.n
            self.first.add(np.array([self.ids.n]))
            self.count.add(np.array([len(ids)]))
            self.ids.add(np.array(ids, np.int32))

    def _join(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Rank and place of what two symbols are joined to, in one number; NONE if that is no piece."""
        key = left.astype(np.int64) * (1 << 22) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at] | place, NONE).astype(np.int32)

    def _learn(self, units: list[str]) -> None:
        """Remember the parts of new units and their plain outcomes."""
        points, size = _codepoints("".join(units)), np.fromiter(map(len, units), np.int64, len(units))
        self._know(points)
        key = points[:-1] << 22 | points[1:]
        cut = np.ones(len(points), bool)
        cut[1:] = self.inside[np.searchsorted(self.inside, key)] != key
        cut[np.cumsum(size)[:-1]] = True
        start = np.flatnonzero(cut)
        length = np.diff(start, append=len(points))
        ends = np.searchsorted(start, np.cumsum(size))
        self.part_count.add(many := np.diff(ends, prepend=0))
        self.part_first.add(self.start.n + ends - many)
        symbols, base = self.symbol[points].astype(np.int32), self.symbols.n
        agenda = np.append(self._join(symbols[:-1], symbols[1:], 0), NONE)
        agenda[np.append(start[1:] - 1, len(points) - 1)] = NONE
        self.symbols.add(symbols)
        self.agenda.add(agenda)
        known = self.start.n
        self.start.add(base + start)
        self.length.add(length)
        ids, count, merged = self._merge(np.arange(known, self.start.n))
        merged[length > LONG] = -1
        self.plain_first.add(self.plain.n + np.cumsum(count) - count)
        self.plain_count.add(count)
        self.plain.add(ids)
        self.left.add(merged)

    def _part(self, k: int) -> str:
        """A long part; all its characters stand in pieces."""
        at = self.start.held[k]
        return "".join(map(self.char.__getitem__, self.symbols.held[at : at + self.length.held[k]].tolist()))

    def _merge(self, parts: np.ndarray, draws: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their count, merges) of each of these parts; with draws, as many candidates are merged before each skip as its draw says."""
        counts, merged = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        order = np.argsort(self.length.held[parts], kind="stable")
        length = self.length.held[parts[order]]
        done: list[np.ndarray] = []
        i, short = 0, int(np.searchsorted(length, LONG, side="right"))
        while i < short:
            widest = int(length[i] * 1.25) + 1  # of much the same length, so that little is padded
            j = min(i + AT_ONCE, int(np.searchsorted(length, widest, side="right")), short)
            symbols, alive = self._merge_few(parts[order[i:j]], None if draws is None else draws[order[i:j]])
            merged[order[i:j]] = length[i:j] - alive
            count = self.count.held[symbols]
            counts[order[i:j]] = np.add.reduceat(count, np.cumsum(alive) - alive)
            done.append(self.ids.held[_spans(self.first.held[symbols], count)])
            i = j
        for k in order[i:].tolist():
            text = self._part(parts[k])
            ids = self._merge_long(text, 0 if draws is None else self.rate, 0 if draws is None else int(draws[k]))
            counts[k] = len(ids)
            done.append(np.array(ids, np.int32))
        ids, sizes = np.concatenate([np.empty(0, np.int32), *done]), counts[order]
        first = np.empty(len(parts), np.int64)
        first[order] = np.cumsum(sizes) - sizes
        return ids[_spans(first, counts)], counts, merged

    def _merge_few(self, parts: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of parts of much the same length, and how many of each."""
        length, m = self.length.held[parts], len(parts)
        w = int(length.max())
        held = np.full((w + 2, m), EDGE, np.int32)  # a column for each part
        agenda = np.full((w + 2, m), NONE, np.int32)
        at = np.arange(w)[:, None]
        row, col = np.nonzero(at < length)
        source = self.start.held[parts][col] + row
        held[row + 1, col] = self.symbols.held[source]
        due = self.agenda.held[source]
        agenda[row + 1, col] = np.where(due == NONE, NONE, due | (row + 1).astype(np.int32))
        after = np.repeat(np.arange(1, w + 3, dtype=np.int16)[:, None], m, axis=1)
        before = np.repeat(np.arange(-1, w + 1, dtype=np.int16)[:, None], m, axis=1)
        result, who = np.full((w + 2, m), EDGE, np.int32), np.arange(m)
        gap = np.full(m, -1) if draws is None else LONG - np.searchsorted(self.least, draws, side="right")
        while len(who):
            best = agenda.min(axis=0)
            c = np.flatnonzero(best != NONE)
            if len(c) < 0.75 * len(who):
                over = np.flatnonzero(best == NONE)
                result[:, who[over]] = held[:, over]
                held, agenda, after, before, who, gap, best = held[:, c], agenda[:, c], after[:, c], before[:, c], who[c], gap[c], best[c]
                draws = None if draws is None else draws[c]
                c = np.arange(len(c))
            best = best[c]
            i = best & 63
            if draws is not None:
                skip = gap[c] == 0
                s = c[skip]
                agenda[i[skip], s] = NONE
                draws[s] = _drawn(draws[s])
                gap[s] = LONG - np.searchsorted(self.least, draws[s], side="right")
                c, i, best = c[~skip], i[~skip], best[~skip]
                gap[c] -= 1
            j = after[i, c]
            k, h, new = after[j, c], before[i, c], best >> 6
            held[i, c], held[j, c] = new, GONE
            agenda[j, c] = NONE
            after[i, c], before[k, c] = k, i
            agenda[i, c] = self._join(new, held[k, c], i)
            agenda[h, c] = self._join(held[h, c], new, h)
        left = (result[1:-1] >= 0).T
        return result[1:-1].T[left], left.sum(axis=1)

    def merge(self, part: str) -> tuple[int, list[int]]:
        """(candidates, ids) of a part (spaces already U+2581), without skips."""
        self._place([part.replace(SPACE, " ")])
        k = self.part_first.held[self.units[part.replace(SPACE, " ")]]
        at = self.plain_first.held[k]
        return int(self.left.held[k]), self.plain.held[at : at + self.plain_count.held[k]].tolist()

    def _place(self, units: list[str]) -> np.ndarray:
        """The units' numbers."""
        got = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        if self.units.fresh:
            self._learn(self.units.fresh)
            self.units.fresh.clear()
        return got

    def _ids(self, parts: list[str]) -> list[int]:
        ids = list(map(self.id.get, parts))
        if None in ids:
            ids = [x for p, i in zip(parts, ids, strict=True) for x in ((i,) if i is not None else map(self.byte.__getitem__, p.encode("utf-8", "surrogatepass")))]
        return ids

    def _merge_long(self, unit: str, rate: int, key: int) -> list[int]:
        """The same with a heap, for units whose agenda is long."""
        get = self.rank.get
        parts: list[str | None] = list(unit)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i in range(n - 1) if (r := get(p := unit[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            r, i, piece = heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != piece:
                continue
            if rate:
                key = (key * 0x5851F42D4C957F2D + r) & _BITS
                if (key >> 40) & 0xFFFF < rate:
                    continue
            parts[i], parts[j] = piece, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(p := piece + parts[after[i]])) is not None:
                    heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := get(p := parts[h] + piece)) is not None:
                heappush(heap, (r, h, p))
        return self._ids([p for p in parts if p is not None])

    def encode(self, text: str | None, rate: int = 0, seed: int = 0, key: int = 0) -> bytes:
        """Ids of a whole text; ``rate`` of 65536 candidates are skipped, drawn by (seed, key, place)."""
        return self.encode_all([text], rate, seed, [key])[0]

    def encode_all(self, texts: list[str | None], rate: int = 0, seed: int = 0, keys: list[int] | None = None) -> list[bytes]:
        """The same of several texts, each with its key."""
        if rate and rate != self.rate:
            # A gap is the count of odds above the draw: more than k candidates are merged first with (1 - rate) ** (k + 1).
            self.rate, self.least = rate, np.array(sorted(((65536 - rate) ** k << 64) >> 16 * k for k in range(1, LONG + 1)), dtype=np.uint64)
        base = [(seed * 0x9E3779B9 + k) & _BITS for k in keys or [0] * len(texts)]
        out: list[list[bytes]] = [[] for _ in texts]
        units: list[str] = []
        block: list[tuple[int, int]] = []  # text and how many of its units; a long text is cut between units
        for k, t in enumerate(texts):
            found = map(re.Match.group, _UNIT.finditer(" " + t)) if t else iter(())
            while some := list(islice(found, BLOCK - len(units))):
                units += some
                block.append((k, len(some)))
                if len(units) == BLOCK:
                    self._encode(units, block, rate, base, out)
                    units, block = [], []
        self._encode(units, block, rate, base, out)
        return list(map(b"".join, out))

    def _encode(self, units: list[str], block: list[tuple[int, int]], rate: int, base: list[int], out: list[list[bytes]]) -> None:
        """Add the ids of a block's units to their texts' and move the texts' ``base`` by the parts that were met."""
        if not units:
            return
        if len(self.units) > self.most or self.symbols.n > 32 * self.most:
            self._forget()
        number = self._place(units)
        count = self.part_count.held[number]
        at = _spans(self.part_first.held[number], count)
        size = np.diff(np.concatenate(([0], np.cumsum(count)))[np.cumsum([0, *(n for _, n in block)])])  # parts of each text
        first, length, ids = self.plain_first.held[at], self.plain_count.held[at], self.plain.all
        if rate:
            draw = _drawn(_spans(np.zeros(len(size), np.int64), size).astype(np.uint64) + np.repeat(np.array([base[k] for k, _ in block], np.uint64), size))
            left = self.left.held[at]
            open_ = np.flatnonzero((LONG - np.searchsorted(self.least, draw, side="right") < left) | (left < 0))
            drawn, n, _ = self._merge(at[open_], draw[open_])
            first[open_] = len(ids) + np.cumsum(n) - n
            length[open_] = n
            ids = np.concatenate((ids, drawn))
        flat = ids[_spans(first, length)].tobytes()
        ends = (4 * np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(size)))]).tolist()
        for (k, _), n, i, j in zip(block, size.tolist(), ends, ends[1:], strict=False):
            out[k].append(flat[i:j])
            base[k] = (base[k] + n) & _BITS

    def decode(self, ids: bytes) -> str:
        """The text of ids that ``encode`` gave."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def _pieces(path: str | None) -> Pieces:
    import public_tokenizers

    return Pieces(path or public_tokenizers.path("piece_bpe_32k.model"))


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 0, model_path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each row's whole text.

    A text's segmentation depends on the seed, the dropout and the text alone, so equal texts agree and
    a run can be repeated. A null or empty text has no ids; repeated rows and null ids stay; other columns are ignored.
    """
    return _encoded(docs, id_col, text_col, dropout, seed, model_path, False)


def decode_pieces(rows: DataFrame, ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``rows`` with text decoded from their ids; null ids give null."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _pieces(model_path)
        for s in batches:
            yield pd.Series([None if x is None else pieces.decode(np.asarray(x, "<u4").tobytes()) for x in s], dtype=object)

    return rows.withColumn("text", text(ids_col))


def _groups(texts: Iterator[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in groups of about so many characters, a longer one alone."""
    group, n = [], 0
    for t in texts:
        if group and n + len(t) > chars:
            yield group
            group, n = [], 0
        group.append(t)
        n += len(t)
    if group:
        yield group


def _encoded(docs, id_col, text_col, dropout, seed, model_path, digest) -> DataFrame:
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be from 0 to less than 1")
    rate = round(dropout * 65536)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for b in batches:
            out = []
            for texts in _groups(t.as_py() or "" for t in b.column(1)):
                keys = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
                for t, ids in zip(texts, pieces.encode_all(texts, rate, seed, keys), strict=True):
                    out.append((len(ids) // 4, zlib.crc32(ids), pieces.decode(ids) == t if t else True) if digest else np.frombuffer(ids, "<i4"))
            if digest:
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True))], names=["doc_id", "n_ids", "ids_crc32", "lossless"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_ids bigint, ids_crc32 bigint, lossless boolean" if digest else f"doc_id {id_type}, ids array<int>")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (little-endian 32-bit ids) and whether the decoded ids equal the text."""
    return _encoded(table(spark, sf_dir, "documents"), "doc_id", "text", 0.1, 0, None, True)
