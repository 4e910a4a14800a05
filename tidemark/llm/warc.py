"""WARC archives: a writer of one gzip member a record, and a reader that splits files by byte ranges.

A range's task looks for the gzip magic, accepts a candidate only if it decodes and begins with a
WARC version line, and owns the records that start inside its range; it reads past the
range's end to finish the last one.  Files are reached through pyarrow.fs, by the URI of the
shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, may_match, slices, work_dir

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes of a range, of one read, and after which a writer begins another file.
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
FILE_BYTES = 1 << 30
#: Tasks of a reader; a task reads several ranges beyond that.
MOST_TASKS = 100_000
LEVEL = 6
PAGE_URN = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "file string, offset long, record_type string, record_id string, url string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value may not break the line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: without a payload a revisit, whose block is the HTTP header, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    lines = [
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if payload is None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> dict[str, object] | None:
    """The fields of one record; None if it isn't a response or revisit with an HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    kind = fields.get(b"warc-type", "")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields.get(b"content-length", "0"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    if kind == "revisit":
        told = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, payload = int(told[0]) if told else 0, None
    else:
        digest = base32_sha1(payload)
    return {
        "record_type": kind,
        "record_id": fields.get(b"warc-record-id", "").strip("<>"),
        "url": fields.get(b"warc-target-uri"),
        "refers_to": fields[b"warc-refers-to"].strip("<>") if b"warc-refers-to" in fields else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


#: Sub-keys of a repeated payload, which a third of all pages may have.
SALTS = 16


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, sha, n_bytes, payload, refers_to, revisit): which record each page gets.

    Of pages with equal payloads of at least least_bytes, what has the largest page_id is the response.  Payloads of
    digests that occur once aren't shuffled, and of repeated ones only those of the responses are: the
    rows of the others have no payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).select("page_id", "url", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").cast("long").alias("n_bytes"), "payload")
    again = cut(
        rows.where(F.col("n_bytes") >= least_bytes)
        .groupBy("sha")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("c"))
        .where("c > 1")
        .select(F.col("sha").alias("again"), "holder")
    )
    flagged = may_match(rows.withColumn("name", F.xxhash64("page_id", "sha")), "sha", again, "again", flag="unsure")
    light = flagged.where("unsure").select("page_id", "url", "sha", "n_bytes", "name", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    dealt = again.select("again", "holder", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("part"))
    named = cut(
        light.join(dealt, (F.col("sha") == F.col("again")) & (F.col("salt") == F.col("part")), "left").withColumn(
            "revisit", F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
        )
    )
    responses = named.where("not revisit").select("name").distinct()
    whole = may_match(flagged.where("unsure"), "name", responses, "name").join(responses, "name", "left_semi")
    none, no = F.lit(None), F.lit(False)
    columns = ["page_id", "url", "sha", "n_bytes"]
    kept = flagged.where("not unsure").select(*columns, "payload").union(whole.select(*columns, "payload"))
    return kept.select(*columns, "payload", none.cast("long").alias("refers_to"), no.alias("revisit")).union(
        named.where("revisit").select(*columns, none.cast("binary"), "holder", "revisit")
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages below folder; (file, bytes, records) of what was written.

    A task attempt writes files of its own names, and the list, itself written to the folder,
    has those of the attempts that Spark accepted: lost or repeated attempts leave nothing in it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in slices(batches):
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                digest = base64.b32encode(row["sha"]).decode()
                data = member(record(row["page_id"], row["url"], row["payload"], row["n_bytes"], digest, row["refers_to"]))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((name, size, count))
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pa.record_batch(
            [
                pa.array([f"{folder}/{x[0]}" for x in done], type=pa.string()),
                pa.array([x[1] for x in done], type=pa.int64()),
                pa.array([x[2] for x in done], type=pa.int64()),
            ],
            names=["file", "bytes", "records"],
        )

    return cut(with_revisits(pages, least_bytes).mapInArrow(write, "file string, bytes long, records long"))


class _Window:
    """A file's bytes from an offset on, read in pieces; what lies before the reader is forgotten."""

    def __init__(self, source: pa.NativeFile, at: int) -> None:
        self.source, self.base, self.data = source, at, bytearray()
        source.seek(at)

    def more(self) -> bool:
        got = self.source.read(READ_BYTES)
        self.data += got
        return bool(got)

    def find(self, at: int, end: int) -> int | None:
        """Where the next magic begins at or after ``at`` and before ``end``."""
        while True:
            found = self.data.find(MAGIC, at - self.base)
            if found >= 0:
                return self.base + found if self.base + found < end else None
            keep = max(at, self.base + len(self.data) - len(MAGIC) + 1)
            if keep >= end:
                return None
            self.forget(keep)
            if not self.more():
                return None
            at = keep

    def forget(self, at: int) -> None:
        del self.data[: at - self.base]  # moves no bytes: the array keeps an offset
        self.base = at

    def decode(self, at: int) -> tuple[bytes, int] | None:
        """The member that starts at ``at`` and where it ends; None if this is no WARC member."""
        unpack, parts, seen, size = zlib.decompressobj(31), [], at, 0
        while not unpack.eof:
            chunk = bytes(self.data[seen - self.base : seen - self.base + READ_BYTES])
            if not chunk:
                if not self.more():
                    return None
                continue
            try:
                part = unpack.decompress(chunk)
            except zlib.error:
                return None
            parts.append(part)
            size += len(part)
            seen += len(chunk) - len(unpack.unused_data)
            if size >= 5 and not (parts[0] if len(parts[0]) >= 5 else b"".join(parts))[:5] == b"WARC/":
                return None
        return (b"".join(parts), seen) if size >= 5 else None


def read_range(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[str, object]]]:
    """(offset, fields) of the records whose members start in [start, end)."""
    window, at = _Window(source, start), start
    while (found := window.find(at, end)) is not None:
        got = window.decode(found)
        if got is None:
            at = found + 1
            continue
        data, at = got
        if (fields := parse(data)) is not None:
            yield found, fields
        window.forget(at)


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of gzipped WARC files (file, bytes): offset, type, ids, url and payload.

    Records of other types, and bytes that belong to no valid member, are passed over.
    """
    ranges = files.select(
        "file", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start")
    )
    # A number of its own: without one, these few small rows would be taken for little work and go to one task.
    ranges = ranges.repartition(min(max(1, ranges.count()), MOST_TASKS))
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = dict(zip(names, [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()], strict=True))

    def pack(rows: list[dict[str, object]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[n] for r in rows], type=types[n]) for n in names], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["file"])
                rows, size = [], 0
                with fs.open_input_file(path) as source:
                    for offset, fields in read_range(source, row["start"], min(row["start"] + split_bytes, row["bytes"])):
                        if not payloads:
                            fields["payload"] = None
                        rows.append(fields | {"file": row["file"], "offset": offset})
                        size += len(fields["payload"] or b"")
                        if len(rows) >= 500 or size >= 8 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    return ranges.mapInArrow(read, RECORD_SCHEMA)


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to): pages after a trip through archives.

    Null html is an empty payload.  A null url has no target header and comes back null.  A null
    page_id is written as an empty id and comes back null; it is never what others refer to.
    Rows that repeat a page_id and payload are responses alike.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    files = write_archives(pages, f"{work_dir(spark)}/warc", least_bytes)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE_URN) + 1}) AS bigint)")
    return read_archives(files, payloads=False).select(
        number("record_id").alias("page_id"),
        "url",
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(range(40), lambda i: substr(
    '0000000100100011010001010110011110001001101010111100110111101111',
    4 * (instr('0123456789abcdef', substr(h, i + 1, 1)) - 1) + 1, 4)), '') AS b,
    max(page_id) OVER (PARTITION BY html) AS holder
  FROM p
)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    16 * substr(b, 5 * j + 1, 1)::INT + 8 * substr(b, 5 * j + 2, 1)::INT + 4 * substr(b, 5 * j + 3, 1)::INT
    + 2 * substr(b, 5 * j + 4, 1)::INT + substr(b, 5 * j + 5, 1)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM bits
"""
