"""Media columns: payloads kept as lossless 8-bit images in archives, read by a custom data source.

A payload is the grey samples of a PNG image, 64 to a row. Members are stored one after
another in archives with a directory (member offsets) at their end. The
data source lists an archive folder's manifest, plans byte ranges over the archives, and each
range's task streams its members as Arrow batches, trying a member that cannot be read
again by its offset, without reading its neighbours again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import MANIFEST, ArchiveWriter, reading
from .common import materialize, shared_dir, table

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_FOOT = "<QQ8s"  # the directory's offset, count of members, magic
_ENTRY = "<QQ?q"  # offset, length, whether there is a key, key
_MAGIC = b"NAVMEDIA"
SCHEMA = "key bigint, offset bigint, media binary, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, n_bytes: int, level: int = 6) -> bytes:
    """A grey 8-bit PNG, ``WIDTH`` samples a row, with the unpadded length as its text. The payload's length is a positive multiple of ``WIDTH``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    image = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter type 0
    image[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\x00%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(image.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length); ValueError if a checksum does not hold."""
    at, data, n = len(_SIGNATURE), [], 0
    if media[:at] != _SIGNATURE:
        raise ValueError("not a PNG image")
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"tEXt":
            n = int(body.split(b"\x00")[1])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    image = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    return image[:, 1:].tobytes(), n


def sound(media: bytes) -> bool:
    """Whether this is a whole image all of whose chunks have their checksum."""
    at, kind = len(_SIGNATURE), b""
    if media[:at] != _SIGNATURE:
        return False
    while at + 12 <= len(media):
        (size,) = struct.unpack_from(">I", media, at)
        end = at + 8 + size
        kind = media[at + 4 : at + 8]
        if end + 4 > len(media) or zlib.crc32(memoryview(media)[at + 4 : end]) != struct.unpack_from(">I", media, end)[0]:
            return False
        at = end + 4
    return at == len(media) and kind == b"IEND"


def features(payload: bytes) -> str:
    """Size of the image, mean and deviation of its samples, and their share in each sixteenth of the range."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x >> 4, minlength=16) / len(x)
    return f"{WIDTH}x{len(x) // WIDTH};mean={x.mean():.4f};sd={x.std():.4f};hist=" + ",".join(f"{s:.4f}" for s in share)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\x00" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 128 << 20) -> DataFrame:
    """Store each row's text as a member of archives under ``folder``; the manifest (path, bytes, records).

    A null text is empty. Rows are stored as often as they occur; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[bytes] = []

        def close(w: ArchiveWriter) -> int:
            tail = b"".join(entries) + struct.pack(_FOOT, w.bytes, len(entries), _MAGIC)
            w.out.write(tail)
            entries.clear()
            return len(tail)

        w = ArchiveWriter(folder, ".media", archive_bytes, close)
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                media = encode(*padded(t.as_py()))
                w.open()
                entries.append(struct.pack(_ENTRY, w.bytes, len(media), key is not None, key or 0))
                w.add(media)
        yield w.manifest()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


class MediaRange(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


def member(path: str, offset: int, length: int, tries: int) -> tuple[bytes | None, str | None]:
    """(bytes, error) of one member; every try opens the archive anew."""
    error = None
    for _ in range(max(1, tries)):
        try:
            with reading(path) as f:
                f.seek(offset)
                data = f.read(length)
            if len(data) == length and sound(data):
                return data, None
            error = "short or damaged member"
        except OSError as e:
            error = str(e)
    return None, error


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.step = int(options.get("rangebytes", 16 << 20))
        self.tries = int(options.get("tries", 3))
        # Null lets failed members pass as rows with an error; else the task fails.
        self.lenient = options.get("onerror", "fail") == "null"
        self.manifest = options.get("manifest")

    def partitions(self) -> list[MediaRange]:
        """Ranges of all archives, from the manifest if there is one, else from a listing of the folder."""
        from pyarrow import fs as pafs
        from pyarrow import parquet

        from .common import filesystem

        if self.manifest:
            fs, path = filesystem(self.manifest)
            rows = parquet.read_table(path, filesystem=fs, columns=["path", "bytes", "records"]).to_pylist()
            listed = [(r["path"], r["bytes"]) for r in rows if r["records"]]
        else:
            fs, path = filesystem(self.folder)
            listed = [(f"{self.folder}/{x.base_name}", x.size) for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".media")]
        return [MediaRange(p, lo, lo + self.step) for p, size in listed for lo in range(0, size, self.step)] or [MediaRange("", 0, 0)]  # Spark asks for one at least

    def read(self, part: MediaRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with reading(part.path) as f:
            size = f.size()
            f.seek(size - struct.calcsize(_FOOT))
            start, count, magic = struct.unpack(_FOOT, f.read(struct.calcsize(_FOOT)))
            if magic != _MAGIC:
                raise ValueError(f"{part.path} is no media archive")
            f.seek(start)
            directory = f.read(count * struct.calcsize(_ENTRY))
            mine = [e for e in struct.iter_unpack(_ENTRY, directory) if part.lo <= e[0] < part.hi]
            rows, held = [], 0
            for offset, length, keyed, key in mine:
                error = None
                try:
                    f.seek(offset)
                    data = f.read(length)
                    if len(data) != length or not sound(data):
                        raise OSError("short or damaged member")
                except OSError:
                    data, error = member(part.path, offset, length, self.tries)
                    if data is None and not self.lenient:
                        raise OSError(f"{part.path}, offset {offset}: {error}") from None
                rows.append((key if keyed else None, offset, data, error))
                held += length
                if held >= 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = pa.int64(), pa.int64(), pa.binary(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "offset", "media", "error"])


class MediaArchives(DataSource):
    """``spark.read.format("nav_media").load(folder)``.

    Options: rangeBytes, tries, onError (fail or null), manifest (folder of the Parquet files that write_media left; without it the folder is listed).
    """

    @classmethod
    def name(cls) -> str:
        return "nav_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def read_media(spark: SparkSession, folder: str, manifest: DataFrame | None = None, **options: str) -> DataFrame:
    """The members of a folder's archives, or of those in the manifest only (files of failed attempts are then ignored).

    The data source reads the manifest, a row for each archive of 128 MB or so, when it plans its ranges.
    """
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("nav_media").options(**options)
    if manifest is not None:
        path = f"{shared_dir(spark)}/manifest"
        manifest.select("path", "bytes", "records").write.parquet(path)
        reader = reader.option("manifest", path)
    return reader.load(folder)


def media_features(members: DataFrame) -> DataFrame:
    """doc_id, sizes, digests and features of each member; equal texts give equal values. A member that could not be read keeps its row, with nulls."""
    kind = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b.column(1):
                media = media.as_py()
                if media is None:
                    rows.append((None,) * 7)
                    continue
                payload, n = decode(media)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            types = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return members.select("key", "media").mapInArrow(run, kind)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/media"
    manifest = write_media(table(spark, sf_dir, "documents"), folder)
    return media_features(read_media(spark, folder, manifest))
