"""A two-level index of captures, searched before archives are read.

Captures are sorted by the key of their url (the host's labels reversed, then port and
path), range by range. Each range is one shard file: blocks of ``BLOCK`` sorted lines,
each compressed on its own, and after them the shard's directory, with the first key and
the byte range of each block. The manifest, one row for each shard, says where a shard's
directory lies and which keys it spans.

A search sends each wanted key to the shards that can hold it: a key that a third of all
captures share lies in many shards, which are searched by different tasks. A task reads
the directory of its shard, finds the first block by binary search, reads that byte range,
and finds the first line by binary search; it goes on while lines have the key.

Files are written under names that no other attempt of a task uses, and only the rows of
committed attempts name files, so a task can be lost and run again.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Lines of a block, and captures of a shard (a shard is one task's work).
BLOCK, SHARD = 1000, 250_000
#: What a capture's line holds besides its key.
FIELDS = ("url", "file", "offset", "length")
CAPTURE = "key string, seq long, url string, file string, offset long, length long"
MANIFEST = "shard_file string, first_key string, last_key string, at long, size long, entries long"
_PORTS = {"http": 80, "https": 443}
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """The sort key of a url: ``com,example,www:8080)/path?query``.

    Scheme, default port, user, fragment and the case of the host don't count. What has no
    host is its own key; null is the empty key. Spaces and control characters are escaped.
    """
    if url is None:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host, port, parts = None, None, None
    if not host:
        key = url
    else:
        labels = ",".join(reversed(host.rstrip(".").split(".")))
        shown = f":{port}" if port and port != _PORTS.get(parts.scheme.lower()) else ""
        key = f"{labels}{shown}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", key)


def open_folder(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder that all executors reach."""
    return pafs.FileSystem.from_uri(root)


@dataclass(frozen=True)
class Index:
    #: (first key, last key, file, where its directory begins, how long it is), in order.
    root: str
    shards: list[tuple[bytes, bytes, str, int, int]]


def build(captures: DataFrame, work: Scratch, block: int = BLOCK, shard: int = SHARD) -> Index:
    """Index ``captures`` (key, seq, and ``FIELDS``); every row is indexed."""
    root, count = f"{work.root}/index", captures.count()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_folder(root)
        out = name = first = last = None
        at = entries = 0
        lines: list[bytes] = []
        directory: list[bytes] = []

        def flush() -> None:
            nonlocal at
            body = zlib.compress(b"\n".join(lines), 6)
            out.write(body)
            directory.append(b"%s %d %d" % (lines[0].split(b" ", 1)[0], at, len(body)))
            at += len(body)
            lines.clear()

        for batch in batches:
            rows = batch.to_pylist()
            if rows and out is None:
                name = f"{uuid.uuid4().hex}.cdx"
                fs.create_dir(folder, recursive=True)
                out, first = fs.open_output_stream(f"{folder}/{name}", compression=None), rows[0]["key"]
            for r in rows:
                held = json.dumps([r[f] for f in FIELDS], separators=(",", ":"))
                lines.append(f"{r['key']} {r['seq']} {held}".encode())
                if len(lines) == block:
                    flush()
            if rows:
                entries, last = entries + len(rows), rows[-1]["key"]
        if out is None:
            return
        if lines:
            flush()
        body = zlib.compress(b"\n".join(directory), 6)
        out.write(body)
        out.close()
        yield pa.RecordBatch.from_pylist(
            [{"shard_file": name, "first_key": first, "last_key": last, "at": at, "size": len(body), "entries": entries}]
        )

    n = max(8, -(-count // shard))
    # The number that follows the key cuts a key with very many captures as well.
    ordered = captures.repartitionByRange(n, "key", "seq").sortWithinPartitions("key", "seq")
    manifest = work.save(ordered.mapInArrow(write, MANIFEST), "manifest")
    rows = manifest.collect()  # one row for each shard
    found = [(r.first_key.encode(), r.last_key.encode(), r.shard_file, r.at, r.size) for r in rows]
    return Index(root, sorted(found))


def search(index: Index, wanted: DataFrame) -> DataFrame:
    """All captures of the keys in ``wanted`` (key; repeats count once), as ``CAPTURE``."""
    shards, root = index.shards, index.root

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [s[0] for s in shards], [s[1] for s in shards]
        for batch in batches:
            keys, to = [], []
            for key in batch.column(0).to_pylist():
                raw = key.encode()
                # Shards are in order: from the first that ends at the key or later.
                for i in range(bisect_left(lasts, raw), bisect_right(firsts, raw)):
                    keys.append(key)
                    to.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(keys, pa.string())], names=["shard", "key"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_folder(root)
        at = handle = None
        firsts: list[bytes] = []
        places: list[tuple[int, int]] = []
        held: tuple[int, list[bytes]] = (-1, [])

        def lines(i: int) -> list[bytes]:
            nonlocal held
            if held[0] != i:
                held = (i, zlib.decompress(handle.read_at(places[i][1], places[i][0])).split(b"\n"))
            return held[1]

        for batch in batches:
            out: list[tuple] = []
            for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != at:
                    if handle:
                        handle.close()
                    _, _, name, begin, size = shards[shard]
                    at, handle, held = shard, fs.open_input_file(f"{folder}/{name}"), (-1, [])
                    listed = [x.rsplit(b" ", 2) for x in zlib.decompress(handle.read_at(size, begin)).split(b"\n")]
                    firsts, places = [x[0] for x in listed], [(int(x[1]), int(x[2])) for x in listed]
                raw = key.encode()
                # The block before the first that begins at the key may end with it.
                i = max(0, bisect_left(firsts, raw) - 1)
                sought = raw + b" "
                while i < len(places):
                    block = lines(i)
                    j = bisect_left(block, sought)
                    while j < len(block) and block[j].startswith(sought):
                        _, seq, rest = block[j].decode().split(" ", 2)
                        out.append((key, int(seq), *json.loads(rest)))
                        j += 1
                        if len(out) >= 10_000:
                            yield _captures(out)
                            out = []
                    if j < len(block):
                        break
                    i += 1
            if out:
                yield _captures(out)
        if handle:
            handle.close()

    asked = wanted.select("key").where(F.col("key").isNotNull()).distinct().mapInArrow(route, "shard int, key string")
    sent = asked.repartitionByRange(max(8, len(shards)), "shard", "key").sortWithinPartitions("shard", "key")
    return sent.mapInArrow(look, CAPTURE)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "seq", *FIELDS])
