"""WARC archives: a deduplicating writer and a salvage reader.

Records are gzip members of WARC/1.1 (or plain records) in archive files of bounded size. The reader checks every
record: the member's own checksum, the header block, the block's length and digest. After a failed check it searches for the next member or
version line that reads well, goes on from there, and reports the bytes between as a quarantined gap with the reason.

Archives are written by the executors into the shared folder of spark.checkpoint.dir through pyarrow's file systems: under a name of the
attempt first, then moved to a name that depends on the partition alone, so that a task which runs again replaces its own file.

Defined results: null html is an empty payload; payloads of at least MIN_REVISIT bytes that are equal make one response, the row with the
smallest page_id (rows that repeat this id are responses too), and all others revisit it; null ids are larger than any, and a group of null ids alone is all
responses; an empty table writes no record; a payload of any length is one record, held in memory by one
task; repeated rows are records of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.common import bound_batches, checkpointed, rows_of

#: Shortest payload in bytes that is stored once; bytes of an archive file, about; gzip's level.
MIN_REVISIT, ARCHIVE_BYTES, LEVEL = 100, 32 << 20, 1
#: Reading tasks at most; with more archives than that a task reads several, one after the other.
MOST_TASKS = 100_000

_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_END = b"\r\n\r\n"


# --------------------------------------------------------------------------- records
@dataclass
class Record:
    """A record with its place in the archive."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int


@dataclass
class Gap:
    """Bytes that couldn't be read, and why."""

    start: int
    end: int
    reason: str


@dataclass
class Salvaged:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


def record_bytes(headers: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """One record; compressed, it is a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + _END + block + _END
    if not compress:
        return data
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(ValueError):
    """A check failed."""


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The plain record that begins at this place: headers, block and where it ends."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    split = data.find(_END, at)
    if split < 0:
        raise Damaged("header block not closed")
    headers = {}
    for line in data[at:split].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not _FIELD.fullmatch(name):
            raise Damaged("malformed header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no content length")
    start = split + 4
    end = start + int(size)
    block = data[start:end]
    if len(block) < int(size) or data[end : end + 4] != _END:
        raise Damaged("block length is wrong")
    known = headers.get("warc-block-digest", "")
    if known.startswith("sha256:") and known[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest is wrong")
    return headers, block, end + 4


def _member(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record in the gzip member that begins at this place."""
    unpacker = zlib.decompressobj(31)
    parts, i = [], at
    try:
        while not unpacker.eof:
            if i >= len(data):
                raise Damaged("member is cut off")
            parts.append(unpacker.decompress(data[i : i + 65536]))  # not the whole rest: records are small
            i += 65536
    except zlib.error as e:
        raise Damaged(f"member: {str(e).split(':')[0]}") from None
    end = min(i, len(data)) - len(unpacker.unused_data)
    plain = b"".join(parts)
    headers, block, used = _parse(plain, 0)
    if used != len(plain):
        raise Damaged("member holds more than a record")
    return headers, block, end


def _next(data: bytes, at: int) -> int:
    """The next place from here on where a member or a version line may begin, or the end."""
    member = data.find(_GZIP, at)
    version = _VERSION.search(data, at, member if member >= 0 else len(data))
    return version.start() if version else member if member >= 0 else len(data)


def salvage(data: bytes) -> Salvaged:
    """Every record that can be read, and the gaps between them.

    A damaged place is left for the next candidate behind it; candidates that don't read well (bytes inside of
    compressed data may look like a start) belong to the same gap.
    """
    out = Salvaged()
    at, bad, reason = 0, -1, ""
    while at < len(data):
        try:
            headers, block, end = _member(data, at) if data.startswith(_GZIP, at) else _parse(data, at)
        except Damaged as e:
            if bad < 0:
                bad, reason = at, str(e)
            at = _next(data, at + 1)
            continue
        if bad >= 0:
            out.gaps.append(Gap(bad, at, reason))
            bad = -1
        out.records.append(Record(headers, block, at, end))
        at = end
    if bad >= 0:
        out.gaps.append(Gap(bad, len(data), reason))
    return out


# --------------------------------------------------------------------------- writing
def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Pages as (page_id, url, html, digest, bytes, first_id); first_id: the response that a revisit refers to, else null."""
    url = F.col(url_col) if url_col and url_col in pages.columns else F.lit(None)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url.cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long")})
    # Digests alone are grouped (with partial sums) and kept only where a payload occurs twice; few rows have one.
    first = (
        rows.filter(F.col("bytes") >= MIN_REVISIT)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .select("d", "first")
    )
    return (
        rows.join(first, F.col("digest") == F.col("d"), "left")
        .withColumn("first_id", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
        .drop("d", "first")
    )


def _headers(page_id: int | None, url: str, digest: str, size: int, first: int | None) -> dict[str, str]:
    ident = "" if page_id is None else str(page_id)
    out = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{ident}/{digest}')}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "text/html; charset=utf-8",
        "X-Page-ID": ident,
        "X-Payload-Length": str(size),
    }
    if first is not None:
        out["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{first}/{digest}')}>"
        out["X-Refers-To-Page"] = str(first)
        out["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return out


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of with_revisits as archives below ``folder`` (a URI all executors can reach); their paths, once written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        partition, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        store.create_dir(base, recursive=True)
        paths: list[str] = []
        out = None

        def name(number: int, tail: str = "") -> str:
            return f"{base}/part-{partition:06d}-{number:04d}.warc.gz{tail}"

        size = 0
        for page_id, url, html, digest, n, first in rows_of(batches, ["page_id", "url", "html", "digest", "bytes", "first_id"]):
            if out is None:
                out, size = store.open_output_stream(name(len(paths), f".{attempt}.tmp"), compression=None), 0
            data = record_bytes(_headers(page_id, url, digest, n, first), b"" if first is not None else html.encode())
            out.write(data)
            size += len(data)
            if size >= archive_bytes:
                out.close()
                store.move(name(len(paths), f".{attempt}.tmp"), name(len(paths)))
                paths.append(name(len(paths)))
                out = None
        if out is not None:
            out.close()
            store.move(name(len(paths), f".{attempt}.tmp"), name(len(paths)))
            paths.append(name(len(paths)))
        yield pa.RecordBatch.from_pydict({"path": paths}, schema=pa.schema([("path", pa.string())]))

    bound_batches(rows.sparkSession)
    # The checkpoint holds the paths of all archives, so they are written once and before anything is read.
    return checkpointed(rows.mapInArrow(run, "path string"))


# --------------------------------------------------------------------------- reading
RECORDS = "path string, start bigint, end bigint, gap_reason string, headers map<string,string>, block binary"


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """All records of the archives, and their quarantined gaps (rows with a gap_reason and no headers)."""
    kind = pa.schema(
        [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap_reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for (path,) in rows_of(batches, ["path"]):
            with store.open_input_stream(path, compression=None) as source:
                found = salvage(source.read())  # bounded by the archive size
            rows = [{"path": path, "start": g.start, "end": g.end, "gap_reason": g.reason} for g in found.gaps]
            held = 0
            for r in found.records:
                rows.append({"path": path, "start": r.start, "end": r.end, "headers": list(r.headers.items()), "block": r.block})
                held += len(r.block)
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    # Paths are short, so a partitioning by size would read all archives in one task; there is one task for each archive instead.
    return paths.repartition(min(MOST_TASKS, max(1, paths.count()))).mapInArrow(run, RECORDS)


def shared_folder(df: DataFrame, name: str) -> str:
    """A new folder's URI below the session's checkpoint folder."""
    base = common.shared_folder(df.sparkSession)
    base = re.sub(r"^file:/+", "file:///", base) if base.startswith("file:") else base
    return f"{base if '://' in base else f'file://{base}'}/{name}-{uuid.uuid4().hex}"


def page_records(records: DataFrame) -> DataFrame:
    """What the records say of their pages; a response's length and digest are those of the payload that was read."""
    h = lambda name: F.element_at("headers", name)
    revisit = h("warc-type") == "revisit"
    return records.filter("gap_reason is null").select(
        F.when(h("x-page-id") != "", h("x-page-id")).cast("long").alias("page_id"),
        F.when(revisit, h("x-payload-length").cast("long")).otherwise(F.octet_length("block").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(h("warc-payload-digest"), ":", -1)).otherwise(F.sha2("block", 256)).alias("payload_digest"),
        h("warc-type").alias("record_type"),
        F.when(revisit, h("x-refers-to-page").cast("long")).alias("refers_to"),
    )
