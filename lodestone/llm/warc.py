"""WARC archives: writing with revisit records, and a salvage reader.

Archives have one gzip member per record. They are written and read by Spark's own file formats,
so any store that Spark reaches will do: the text writer puts the members in a row with a NUL
after each, which is the high byte of a member's size field (a member of 16 MiB or more keeps its
own last byte, and the NUL after it is padding that gzip readers skip).

The salvage reader checks every record (gzip checksum, version line, header, length, block
digest). After a failed check it searches for the next member or version line that begins a valid
record, goes on from there, and logs the bytes between as a gap. Records and gaps come one at a
time from one pass over a file, which is read whole (Spark's binary files are of 2 GB at most;
the writer cuts archives by bytes far below that).
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, batch, few, materialize, new_path

#: Members are put together in rows of so many bytes at least, and so many of these rows make a file.
ROW_BYTES, ROWS_PER_FILE = 4 << 20, 16
#: Bytes that are unpacked at a time.
STEP = 16_384
#: Bytes of a record's header at most.
HEADER = 1 << 20
#: Bytes of a file name or comment in a gzip member's header at most.
NAMES = 4_096
DATE = "2024-01-01T00:00:00Z"
_begin = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_version = re.compile(rb"WARC/\d\.\d\r\n")
_later = re.compile(rb"\r\nWARC/\d\.\d\r\n")


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes
    #: Bytes of the archive that hold it, with others of its member; 0 if the member isn't whole.
    length: int = 0

    @property
    def payload(self) -> bytes:
        """The block without its HTTP header, if it has one."""
        return self.block.partition(b"\r\n\r\n")[2] if self.block.startswith(b"HTTP/") or "application/http" in self.headers.get("content-type", "").lower() else self.block

    @property
    def payload_fits(self) -> bool:
        """Whether the payload has its digest; revisits and records without a SHA-1 have none to check."""
        algorithm, _, digest = self.headers.get("warc-payload-digest", "").partition(":")
        if self.headers.get("warc-type") == "revisit" or algorithm.lower() != "sha1":
            return True
        return digest.upper() == base32_sha1(self.payload) or digest.lower() == hashlib.sha1(self.payload).hexdigest()


@dataclass
class Gap:
    """Quarantined bytes, or those of a record whose payload has another digest than it says."""

    offset: int
    length: int
    reason: str


@dataclass
class Salvaged:
    records: list[Record] = field(default_factory=list)
    #: (offset, length, reason) of quarantined bytes.
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(headers: dict[str, str], block: bytes) -> bytes:
    """An uncompressed record; block digest and length are added."""
    lines = [f"{k}: {v}".replace("\r", " ").replace("\n", " ") for k, v in headers.items()]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _parse(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at `at` and its end, or None and what is wrong with it."""
    if not _version.match(data, at):
        return None, at, "no version line"
    later = _later.search(data, at, at + HEADER)
    end = data.find(b"\r\n\r\n", at, later.start() + 2 if later else at + HEADER)
    if end < 0:  # what follows belongs to a later record: no header is read twice
        return None, at, "header not ended"
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad header line"
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id"} <= headers.keys():
        return None, at, "mandatory header missing"
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or len(length.lstrip("0")) > 18:
        return None, at, "no length"
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "length doesn't fit"
    block = data[start:stop]
    algorithm, _, digest = headers.get("warc-block-digest", "").partition(":")
    if algorithm.lower() == "sha1" and digest.upper() != base32_sha1(block):
        return None, at, "block digest differs"
    return Record(at, headers, block), stop + 4, ""


def _gzip_header(data: bytes, at: int) -> bool:
    """Whether the header of a gzip member is one that ends within NAMES bytes for each name it has."""
    if len(data) < at + 10 or data[at + 2] != 8 or data[at + 3] & 0xE0:
        return len(data) < at + 10
    flags, end = data[at + 3], at + 10
    if flags & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            end = data.find(b"\0", end, end + NAMES) + 1
            if not end:
                return False
    return True


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at `at` gives, its end, and what is wrong with it."""
    if not _gzip_header(data, at):
        return b"", at, "bad gzip member"
    unpack, raw, end = zlib.decompressobj(31), [], at
    before = unpack
    try:
        while not unpack.eof and end < len(data):
            before = unpack.copy()
            raw.append(unpack.decompress(data[end : end + STEP]))
            end += STEP
    except zlib.error:
        left = min(STEP, len(data) - end)
        while left:  # up to the byte that fails, by halves
            half, trial = (left + 1) // 2, before.copy()
            try:
                raw.append(trial.decompress(data[end : end + half]))
                before, end, left = trial, end + half, left - half
            except zlib.error:
                left = half if half < left else 0
        return b"".join(raw), at, "bad gzip member"
    if not unpack.eof:
        return b"".join(raw), at, "gzip member not ended"
    return b"".join(raw), min(end, len(data)) - len(unpack.unused_data), ""


def _member(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """The valid records of the gzip member at `at`, its end, and what is wrong with the rest.

    After a bad record the next version line is searched for. A member that isn't whole has its
    start as its end; if its bytes are bad, only records with a block digest count, and of a cut
    member so does a record at the very end of what it gave.
    """
    whole, end, wrong = _unpacked(data, at)
    records, inner, why = [], 0, ""
    while inner < len(whole):
        record, stop, reason = _parse(whole, inner)
        checked = record and record.headers.get("warc-block-digest", "").lower().startswith("sha1:")
        if record and not checked and (wrong == "bad gzip member" or wrong and stop == len(whole)):
            record, reason = None, wrong
        if record is None:
            why = why or reason
            found = _version.search(whole, inner + 1)
            inner = found.start() if found else len(whole)
            continue
        record.offset = at
        records.append(record)
        inner = stop
    return records, end, wrong or why or ("" if records else "empty member")


def scan(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive, of gzip members, plain records or both, and the gaps, in order.

    Bytes that belong to no valid record are gaps; NULs and line ends between records are padding.
    A member with both good and bad records is a gap too. An empty archive has neither records nor
    gaps. No more than one member's records are held.
    """
    at, lost = 0, None
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            records, end, why = _member(data, at)
        elif data[at] in b"\x00\r\n" and lost is None:
            at += 1
            continue
        else:
            record, end, why = _parse(data, at)
            records = [record] if record else []
        if records:
            if lost is not None:
                yield Gap(lost[0], at - lost[0], lost[1])
                lost = None
            for r in records:
                r.length = max(end - at, 0)
                yield r
            if why and end > at:
                yield Gap(at, end - at, why)
            if end > at:
                at = end
                continue
        lost = lost or (at, why)
        found = _begin.search(data, at + 1)
        at = found.start() if found else len(data)
    if lost is not None:
        yield Gap(lost[0], len(data) - lost[0], lost[1])


def salvage(data: bytes) -> Salvaged:
    """What `scan` finds, gathered."""
    out = Salvaged()
    for x in scan(data):
        if isinstance(x, Gap):
            out.gaps.append((x.offset, x.length, x.reason))
        else:
            out.records.append(x)
    return out


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    """The number in a page's record id; ids of other writers have none."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", uri)
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def page_record(page_id: int | None, url: str | None, html: bytes, size: int, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit whose HTTP header tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _page_uri(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": url or "",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(sha1).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _page_uri(refers_to)}
    return make_record(headers, http if revisit else http + html)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, row_bytes: int = ROW_BYTES, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write a record for each row of `pages` (page_id, url, html) as archives under `path`.

    Of rows with equal payloads of `least_bytes` or more the largest page_id is the response and
    the others revisit it; a null page_id is the smallest. Rows that repeat the response's page_id
    are responses too. Which rows are revisits is found on ids and digests; html isn't shuffled
    unless there are too many revisits to broadcast. Files are cut by bytes.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("html"))).withColumn("size", F.octet_length("html").cast("long"))
    digests = materialize(rows.where(F.col("size") >= least_bytes).select("page_id", "sha1"), "warc-digests")
    best = digests.groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = digests.join(best, "sha1").where(~F.col("page_id").eqNullSafe(F.col("best"))).distinct()
    again = few(materialize(again.select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "best"), "warc-revisits"), BROADCAST_IDS // 4)
    rows = rows.join(again, (F.col("sha1") == F.col("_sha1")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    revisit = F.col("_sha1").isNotNull()
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "sha1", "best", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            whole = b"".join(members)
            return pa.RecordBatch.from_arrays([pa.array([whole if whole[-1] else whole[:-1]], pa.binary())], names=["value"])

        members, size = [], 0
        for b in batches:
            for k in range(0, b.num_rows, 100):
                for page_id, url, html, length, sha1, to, again in zip(*(c.to_pylist() for c in b.slice(k, 100).columns)):
                    members.append(gzip_member(page_record(page_id, url, html or b"", length, sha1, to, again)))
                    size += len(members[-1])
                    if size >= row_bytes:
                        yield row()
                        members, size = [], 0
        if members:
            yield row()

    members = rows.mapInArrow(run, "value binary").selectExpr("cast(value as string) value")
    members.write.option("lineSep", "\u0000").option("maxRecordsPerFile", rows_per_file).text(path)


_SALVAGED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, path string, offset long, record_id string, length long, reason string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in _SALVAGED.split(", ")])
#: Records of a batch that a reader hands on.
BATCH = 200


def _found(name: str, x: Record | Gap, payloads: bool) -> tuple:
    """A row of _SALVAGED: a gap has just path, offset, length and reason, a record no reason."""
    if not isinstance(x, Gap) and not x.payload_fits:
        x = Gap(x.offset, x.length, "payload digest differs")
    if isinstance(x, Gap):
        return (None,) * 7 + (name, x.offset, None, x.length, x.reason)
    payload, kind, digest = x.payload, x.headers.get("warc-type", ""), x.headers.get("warc-payload-digest")
    again = kind == "revisit"
    length = re.search(rb"(?i)content-length: *([0-9]{1,18})(?![0-9])", x.block[: len(x.block) - len(payload)])
    size = int(length[1]) if length and again else len(payload)
    refers = _page_id(x.headers["warc-refers-to"]) if again and "warc-refers-to" in x.headers else None
    kept = payload if payloads and not again else None
    return _page_id(x.headers["warc-record-id"]), size, digest and digest.removeprefix("sha1:"), kind, refers, x.headers.get("warc-target-uri"), kept, name, x.offset, x.headers["warc-record-id"], x.length, None


def salvage_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives under `path`, from one pass.

    A record has no `reason`; a gap has one, with path, offset and length. Records of any type and
    writer are read; page_id is null where record_id isn't a page's. One whose payload differs from
    its digest is a gap; a missing digest is no fault.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for x in scan(content.as_py()):
                    rows.append(_found(name, x, payloads))
                    size += len(rows[-1][6] or b"")
                    if len(rows) >= BATCH or size >= ROW_BYTES:
                        yield batch(_SCHEMA, list(zip(*rows)))
                        rows, size = [], 0
                if rows:
                    yield batch(_SCHEMA, list(zip(*rows)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(run, _SALVAGED)


def read_archives(spark, path: str) -> DataFrame:
    """One row per valid record of the archives under `path`, with its payload (none for revisits)."""
    return salvage_archives(spark, path).where("reason is null").drop("length", "reason")


def read_gaps(spark, path: str) -> DataFrame:
    """The log of quarantined bytes, and of records with another payload than their digest says: path, offset, length, reason."""
    return salvage_archives(spark, path, payloads=False).where("reason is not null").select("path", "offset", "length", "reason")


def round_trip(pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write `pages` as archives in the shared folder and read them back; the payloads can be left out.

    Records and gaps come from one pass and are kept as a table; gaps are logged as a warning. Null
    html is an empty payload; null urls come back empty. Other columns are ignored, repeated rows
    have a record each, and an empty table gives no rows. Archives are written and read before this
    returns.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path, least_bytes)
    found = materialize(salvage_archives(spark, path, payloads), "warc-found")
    lost = found.where("reason is not null").agg(F.count("*"), F.sum("length")).first()
    if lost[0]:
        logging.getLogger(__name__).warning("%d gaps of %d bytes in all quarantined in %s", lost[0], lost[1], path)
    return found.where("reason is null").drop("length", "reason")
