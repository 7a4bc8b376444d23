"""WARC archives: written with revisit records, read back by boundary-chain verification.

Reading splits archives into byte ranges. A task lists every place in its range
that looks like a record's start and the offset at which such a record would end; as
payloads may hold the same magic, a place counts only if the chain of
successors from the file's start comes to it. Within its range a task follows
successors itself, so each candidate leads to an exit, an offset beyond the range.
Across ranges, pointer jumping doubles the length of these jumps in each round until
all ranges' entries are known. Then each range is read from its entry on, record by record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import MANIFEST, reading, written
from .common import materialize, shared_dir, table

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
HEAD = 1 << 16  # bytes read at first for a header, which may be longer
LEAST_PAYLOAD = 100
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d{1,18})(?=\r\n)")


def record(page_id: int | None, url: str | None, payload: str | None, digest: str, first: int | None) -> bytes:
    """A response record, or a revisit record of ``first`` with no block."""
    data = b"" if first is not None else (payload or "").encode("utf-8", "surrogatepass")
    size = len((payload or "").encode("utf-8", "surrogatepass"))
    # A header holds no line ends; what is no printable character of the address is escaped.
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.0", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"X-Payload-Length: {size}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{first}')}>", f"X-Refers-To-Page-ID: {first}"]
    return "\r\n".join([*head, f"Content-Length: {len(data)}"]).encode("utf-8", "surrogatepass") + END + data + END


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_PAYLOAD, archive_bytes: int = 128 << 20, broadcast_rows: int = 200_000, salts: int = 16) -> DataFrame:
    """Write one record per row into archives under ``folder``; the manifest (path, bytes, records).

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest
    id becomes a response and the others revisits of it. A null payload is empty. Only
    digests are grouped; payloads stay in the task that read them, unless there are so many groups of
    copies that their table is shuffled instead of broadcast: then those of ``least`` bytes or more are, each digest dealt to ``salts`` tasks.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups.select("digest", "first"), "groups")
    large = F.octet_length("payload") >= least
    first = F.when(large & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    if groups.count() <= broadcast_rows:  # about a hundred bytes a row
        marked = rows.join(F.broadcast(groups), "digest", "left").select("id", "url", "payload", "digest", first.alias("first"))
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = rows.where(large).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
        marked = dealt.join(salted, ["digest", "salt"], "left").select("id", "url", "payload", "digest", first.alias("first"))
        marked = marked.unionByName(rows.where(~large).select("id", "url", "payload", "digest", F.lit(None).cast("long").alias("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return written(batches, record, folder, ".warc", archive_bytes)

    return materialize(marked.mapInArrow(run, MANIFEST), "manifest")


def _header(data: bytes, at: int) -> tuple[int, int] | None:
    """(header's length with its blank line, block's length) of a record at ``at``, if it looks like one."""
    end = data.find(END, at)
    m = end >= 0 and _LENGTH.search(data, at, end + 2)
    return (end + 4 - at, int(m[1])) if m else None


def candidates(path: str, size: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(offset, exit, records up to the exit) of all that looks like a record's start in [lo, hi)."""
    with reading(path) as f:
        f.seek(lo)
        data, more, seen = f.read(min(size, hi + HEAD) - lo), HEAD, 0
        starts = [m.start() for m in re.finditer(re.escape(MAGIC), data) if m.start() < hi - lo]
        # A header is as long as its address: read on until the last one has its blank line.
        while starts and data.find(END, max(starts[-1], seen)) < 0 and lo + len(data) < size:
            seen = max(0, len(data) - len(END))
            data, more = data + f.read(min(more, size - lo - len(data))), 2 * more
    after: dict[int, int] = {}
    end, length = -1, None
    for at in starts:  # both searches go ahead only, however many places share a blank line
        end = data.find(END, at) if end < at else end
        length = _LENGTH.search(data, at) if length is None or length.start() < at else length
        if end < 0 or length is None:
            break
        if length.end() <= end and (to := lo + end + len(END) + int(length[1]) + len(END)) <= size:
            after[lo + at] = to
    out: dict[int, tuple[int, int]] = {}
    for x in sorted(after, reverse=True):  # successors lie ahead, so theirs is known already
        to, n = out.get(after[x], (-1, 0)) if after[x] < hi else (after[x], 0)
        out[x] = to, n + 1
    return [(x, to, n) for x, (to, n) in out.items() if to >= 0]  # a chain that breaks off within the range leads nowhere


def _entries(ranges: DataFrame, manifest: DataFrame, range_bytes: int) -> DataFrame:
    """(path, size, lo, hi, entry): the first true record of each range that has one.

    Raises ValueError if the chain of an archive ends before the archive does or has not the manifest's count of records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, lo, hi in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                found = candidates(path, size, lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))], names=["path", "at", "to", "n"])

    jump = once = materialize(ranges.mapInArrow(run, "path string, at bigint, to bigint, n bigint"), "jumps")
    # A first candidate need not be in range 0 only: the chain starts at offset 0 of every archive.
    reached = jump.where("at = 0").select("path", "at")
    most = ranges.groupBy("path").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    for i in range(max(0, most - 1).bit_length()):
        ahead = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = materialize(reached.unionByName(ahead).distinct(), "reached")
        if i + 1 < max(0, most - 1).bit_length():
            far = jump.select("path", F.col("at").alias("to"), F.col("to").alias("further"))
            jump = materialize(jump.join(far, ["path", "to"]).select("path", "at", F.col("further").alias("to")), "jumps")
    first = reached.select("path", F.col("at").alias("entry"), (F.floor(F.col("at") / range_bytes) * range_bytes).alias("lo"))
    entries = materialize(ranges.join(first, ["path", "lo"]).where("entry < hi"), "entries")
    read = entries.join(once.withColumnRenamed("at", "entry"), ["path", "entry"]).groupBy("path").agg(F.sum("n").alias("n"), F.max("to").alias("end"))
    short = manifest.join(read, "path", "left").where("records <> coalesce(n, 0) or bytes <> coalesce(end, 0)").select("path", "records", "bytes", "n", "end").take(3)
    if short:
        raise ValueError(f"archives whose records are not those of the manifest: {short}")
    return entries


def read_warc(manifest: DataFrame, range_bytes: int = 16 << 20, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's archives.

    Columns: path, offset, record_type, page_id, url, refers_to, payload_bytes,
    payload_digest (both computed from a response's bytes, and taken from the header of a
    revisit) and, if asked for, payload as binary. No archives give no rows. Headers may have any length.
    An archive whose chain of records breaks off or has not the manifest's count of records raises ValueError
    at once; a response whose digest differs from its header's does so when it is read.
    """
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", F.col("bytes").alias("size"), step.alias("lo"))
    ranges = ranges.withColumn("hi", F.least(F.col("lo") + range_bytes, "size")).repartition("path", "lo")
    entries = _entries(ranges, manifest, range_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, _size, hi, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                yield from _records(path, at, hi, with_payload)

    kind = "path string, offset bigint, record_type string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, payload_digest string"
    return entries.select("path", "size", "hi", "entry").repartition("path", "entry").mapInArrow(run, kind + ", payload binary" * with_payload)


def _records(path: str, at: int, hi: int, with_payload: bool, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["path", "offset", "record_type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "payload"]
    k = 9 if with_payload else 8

    def batch(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], types[:k], strict=True)], names=names[:k])

    found: list[tuple] = []
    with reading(path) as f:
        size = f.size()
        data, base = b"", at
        while at < hi:
            if at - base + HEAD > len(data) and base + len(data) < size:
                f.seek(at)
                data, base = f.read(max(HEAD, min(4 << 20, size - at))), at
            h = _header(data, at - base) if data.startswith(MAGIC, at - base) else None
            more = len(data)
            while h is None and data.startswith(MAGIC, at - base) and base + len(data) < size:  # a longer header
                f.seek(at)
                data, base, more = f.read(max(2 * HEAD, 2 * more)), at, max(2 * HEAD, 2 * more)
                h = _header(data, 0)
            if h is None:
                raise ValueError(f"{path}, offset {at}: no record starts here")
            head = dict(x.split(": ", 1) for x in data[at - base : at - base + h[0] - 4].decode("utf-8", "surrogatepass").split("\r\n")[1:])
            lo = at + h[0]
            if lo - base + h[1] <= len(data):
                payload = data[lo - base : lo - base + h[1]]
            else:
                f.seek(lo)
                payload = f.read(h[1])
            page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
            digest, length = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
            if head["WARC-Type"] == "response":
                if (own := hashlib.sha256(payload).hexdigest()) != digest:
                    raise ValueError(f"{path}, offset {at}: the payload's digest is not its header's")
                digest, length = own, len(payload)
            found.append((path, at, head["WARC-Type"], page and int(page), head["WARC-Target-URI"], refers and int(refers), length, digest, payload))
            at = lo + h[1] + len(END)
            if len(found) >= rows:
                yield batch(found)
                found = []
    yield batch(found)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc")
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), g as (
    select *, min(page_id) over (partition by payload_digest) as first from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from g
"""
