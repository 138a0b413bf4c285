"""WARC archives of pages, written and read back through a two-level capture index.

A page becomes one record, a gzip member of its own. Of the pages with equal payloads
(the html in UTF-8) that with the smallest page_id is a response; the others revisit it:
their records hold the digest, the length and the id of the response, not the payload.
Payloads shorter than ``min_bytes`` are always responses.

Which page is first is decided over digests: they are counted with a combine before the
shuffle, and only digests that several pages share are joined back. They are broadcast
after their number has been checked; beyond the bound, pages are joined by digest, those
of frequent digests by broadcast (as many as can be that frequent).

Reading goes through ``captures``: the keys of the wanted urls are searched, the captures
found are sorted by place, neighbouring byte ranges are read as one, and each record is
parsed by its own lengths. A payload that does not have its digest is an error.

Cases: a null html is the empty payload. A null url has no target and its own key; urls
that share a key, or are equal, are different captures. Null page ids come last among equal
payloads; a revisit of a page without an id refers to null. Rows that are equal in all are
different pages: one is the response. Extra columns are ignored; an empty table gives an
empty archive. A record is held in memory whole, as is the batch it came in.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import captures as cp
from tidemark.llm.scratch import Scratch
from tidemark.operators.skew import BROADCAST_ROWS, lookup_join

#: An archive file is closed when it has this many bytes.
FILE_BYTES = 256 << 20
#: Neighbouring records are read together up to this many bytes.
READ_BYTES = 4 << 20
#: Bytes of an archive that one task reads, if all of it is read.
TASK_BYTES = 32 << 20
#: Beyond the broadcast, digests with a larger share of all pages are joined apart.
HOT_SHARE, HOT_LEAST = 50_000, 20_000
DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_END = b"\r\n\r\n"
_ID = re.compile(r"<urn:x-page:(-?\d*)\.\d+>")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


@dataclass(frozen=True)
class Archive:
    root: str
    index: cp.Index
    #: (key, seq, url, file, offset, length) of every record written.
    captures: DataFrame
    #: Bytes of all records.
    size: int


def record_id(page_id: int | None, seq: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}.{seq}>"


def page_of(record: str | None) -> int | None:
    found = _ID.fullmatch(record or "")
    return int(found[1]) if found and found[1] else None


def make_record(page_id: int | None, seq: int, url: str | None, payload: bytes, digest: str, first: tuple[int | None, int] | None) -> bytes:
    """One record. ``first`` is the (page_id, seq) of the response that a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {record_id(page_id, seq)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if first:
        head += [f"WARC-Refers-To: {record_id(*first)}", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + _END + block + _END, 6, mtime=0)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a gzip member."""
    raw = zlib.decompress(member, 31)
    at = raw.index(_END)
    warc = _headers(raw[:at])
    block = raw[at + 4 : at + 4 + int(warc["content-length"])]
    if raw[at + 4 + len(block) :] != _END:
        raise ValueError(f"record {warc.get('warc-record-id')} does not end where its length says")
    at = block.index(_END)
    return warc, _headers(block[:at]), block[at + 4 :]


def _write(root: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = cp.open_folder(root)
        out = name = None
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("page_id", "seq", "url", "payload", "digest", "first_id", "first_seq")]
            for i in range(batch.num_rows):
                page, seq, url, payload, digest, first_id, first_seq = (c[i].as_py() for c in columns)
                if out is None:
                    # A name of this attempt alone: what a lost attempt left is never named.
                    fs.create_dir(folder, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = fs.open_output_stream(f"{folder}/{name}", compression=None), 0
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                first = (first_id, first_seq) if first_seq is not None and first_seq != seq else None
                body = make_record(page, seq, url, payload, b32, first)
                out.write(body)
                rows.append((cp.url_key(url), seq, url, name, at, len(body)))
                at += len(body)
                if at >= file_bytes:
                    out.close()
                    out = None
            if rows:
                yield cp._captures(rows)
        if out is not None:
            out.close()

    return write


def archive(
    pages: DataFrame,
    min_bytes: int = 0,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    file_bytes: int = FILE_BYTES,
    side_rows: int = BROADCAST_ROWS,
) -> Archive:
    """Write ``pages`` as WARC files, one record each, and index them."""
    work = Scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    named = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    # Numbers tell equal rows apart; they are written, so that they stay the same.
    numbered = work.save(named.select("*", F.sha1("payload").alias("digest"), F.monotonically_increasing_id().alias("seq")), "pages")
    total = numbered.count()
    # Shorter payloads have no key to join by.
    keyed = numbered.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.col("digest")))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "seq")
    firsts = (
        keyed.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("key", F.col("first.page_id").alias("first_id"), F.col("first.seq").alias("first_seq"))
    )
    firsts = work.save(firsts, "firsts")
    if firsts.limit(side_rows + 1).count() <= side_rows:
        told = keyed.join(F.broadcast(firsts), "key", "left")
    else:
        told = lookup_join(keyed, firsts, "key", max(HOT_LEAST, total // HOT_SHARE))
    root = f"{work.root}/archive"
    written = work.save(told.drop("key").mapInArrow(_write(root, file_bytes), cp.CAPTURE), "captures")
    work.drop("pages", "firsts")
    size = int(written.agg(F.sum("length")).first()[0] or 0)
    return Archive(root, cp.build(written, work), written, size)


def wanted_keys(urls: DataFrame, url: str = "url") -> DataFrame:
    """The distinct index keys (key) of a column of urls."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([cp.url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(F.col(url).cast("string")).distinct().mapInArrow(keys, "key string").distinct()


def read_records(archived: Archive, found: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """Read the captures in ``found`` (file, offset, length): ``RECORD`` and payload (null for a revisit)."""
    root = archived.root

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = cp.open_folder(root)
        handle = name = None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            lo = 0
            while lo < len(files):
                hi, end = lo + 1, offsets[lo] + lengths[lo]
                while hi < len(files) and files[hi] == files[lo] and offsets[hi] == end and end - offsets[lo] < read_bytes:
                    end += lengths[hi]
                    hi += 1
                if files[lo] != name:
                    if handle:
                        handle.close()
                    name = files[lo]
                    handle = fs.open_input_file(f"{folder}/{name}")
                body = handle.read_at(end - offsets[lo], offsets[lo])
                yield _records([body[offsets[i] - offsets[lo] : offsets[i] - offsets[lo] + lengths[i]] for i in range(lo, hi)])
                lo = hi
        if handle:
            handle.close()

    # The rows are small, what they point to is not: partitions go by the archive's bytes.
    parts = max(8, archived.size // TASK_BYTES)
    placed = found.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, f"{RECORD}, payload binary")


def _records(members: list[bytes]) -> pa.RecordBatch:
    out: list[tuple] = []
    for member in members:
        warc, http, payload = parse_record(member)
        digest, revisit = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"] == "revisit"
        if not revisit and (base32_digest(payload) != digest or len(payload) != int(http["content-length"])):
            raise ValueError(f"record {warc['warc-record-id']} does not have its digest")
        size = int(http["content-length"]) if revisit else len(payload)
        refers = page_of(warc.get("warc-refers-to")) if revisit else None
        out.append((page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), size, digest, warc["warc-type"], refers, None if revisit else payload))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))


def look_up(archived: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """The records of all captures whose url has the key of one in ``urls``."""
    return read_records(archived, cp.search(archived.index, wanted_keys(urls, url)))
