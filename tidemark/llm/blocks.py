"""Documents dealt into blocks, and what blocks tell one another by hash.

A block holds the documents whose ids share a hash; one task works on one block as
arrays. Blocks send packed arrays, ordered by key and cut by ranges of the key, to
parts; a part sees a key at most once from each block, however often it occurs there,
so a passage that a third of all documents share stays small. A part answers each
block. All of it is one plan: texts are shuffled once, and lost pieces are made again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.scratch import text_bytes

#: Text bytes of a block: a two-thousandth of the input inside these bounds.
LEAST_BLOCK, MOST_BLOCK = 8 << 20, 24 << 20
MESSAGE = "target int, block int, kind int, body binary"
#: The id that a null id counts as: after all others.
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Layout:
    blocks: int
    parts: int


def layout(docs: DataFrame, text: str = "text") -> Layout:
    total = text_bytes(docs, text)
    block = min(MOST_BLOCK, max(LEAST_BLOCK, total // 2000))
    blocks = max(8, -(-total // block))
    return Layout(blocks, blocks)


def dealt(docs: DataFrame, at: Layout, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, doc_id, text, and the columns ``carry`` as _0, _1 ...), dealt by block."""
    # Rows without an id are spread by their text.
    block = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("bigint"), F.xxhash64(text))), F.lit(at.blocks)).cast("int")
    more = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    named = docs.select(block.alias("block"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *more)
    return named.repartitionById(at.blocks, F.col("block"))


def messages(found: DataFrame, to: str, count: int) -> DataFrame:
    """Messages at their receivers, each receiver in one partition of its own."""
    sender = ["block"] if to != "block" else []
    return found.select(F.col("target").alias(to), *sender, "kind", "body").repartitionById(count, F.col(to))


def together(a: DataFrame, b: DataFrame, count: int) -> DataFrame:
    """Two kinds of messages for the blocks, dealt like the blocks."""
    return a.union(b).repartitionById(count, F.col("block"))


def doc_ids(column: pa.ChunkedArray) -> np.ndarray:
    return tx.one_array(column).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def table_of(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    target, block, kind, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table(
        {
            "target": pa.array(target, pa.int32()),
            "block": pa.array(block, pa.int32()),
            "kind": pa.array(kind, pa.int32()),
            "body": pa.array(body, pa.binary()),
        }
    )


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: ranges of equal width, in the order of the hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def least_by_key(keys: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct keys in order: the index of the row least by ``order``, and the
    number of the key of each row."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.lexsort((*order[::-1], keys))
    ordered = keys[by]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    number = np.empty(len(keys), np.int64)
    number[by] = np.cumsum(new) - 1
    return by[new], number


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length in one body."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(bodies: list[bytes], *kinds: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of all bodies joined, and how many rows each body has."""
    counts = np.array([int.from_bytes(b[:8], "little") for b in bodies], np.int64)
    out = []
    places = [8] * len(bodies)
    for kind in kinds:
        width = np.dtype(kind).itemsize
        parts = []
        for i, b in enumerate(bodies):
            parts.append(np.frombuffer(b, kind, int(counts[i]), places[i]))
            places[i] += width * int(counts[i])
        out.append(np.concatenate(parts) if parts else np.zeros(0, kind))
    return out, counts


def cut_by_part(part: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the non-empty ranges of an ordered array of parts."""
    bounds = np.searchsorted(part, np.arange(parts + 1))
    return [(p, int(bounds[p]), int(bounds[p + 1])) for p in np.flatnonzero(np.diff(bounds)).tolist()]


def firsts(table: pa.Table, kind: int) -> pa.Table:
    """A part's answer to (key, doc, place) messages: for every key that more than one block
    has, its least (doc, place), to each of these blocks."""
    bodies, senders = table.column("body").to_pylist(), table.column("block").to_numpy()
    (keys, doc, place), counts = unpack(bodies, "<u8", "<i8", "<u4")
    block = np.repeat(senders, counts)
    if not len(keys):
        return table_of([])
    # Most keys come from one block only: find the others by sorting without an order of rows.
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return table_of([])
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    shared = twice[at] == keys
    keys, doc, place, block = keys[shared], doc[shared], place[shared], block[shared]
    least, number = least_by_key(keys, doc, place)
    out = []
    order = np.lexsort((keys, block))
    ends = np.r_[np.flatnonzero(np.diff(block[order])) + 1, len(order)]
    lo = 0
    for hi in ends.tolist():
        mine = order[lo:hi]
        first = least[number[mine]]
        out.append((int(block[mine[0]]), -1, kind, pack(keys[mine], doc[first], place[first])))
        lo = hi
    return table_of(out)
