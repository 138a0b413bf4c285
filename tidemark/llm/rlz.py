"""Substring dedup by relative Lempel-Ziv parsing.

Every block of documents is a reference with an index: winnowed seeds of K words, each
with the place where it occurs first. The indexes of all blocks are merged by seed, so
each seed of a document points to its first occurrence anywhere. A document is then
parsed from left to right into factors: the longest runs of seeds that point into one
document at one distance. Neighbouring seeds overlap, so the words of a factor are
equal word by word to the place it refers to. Factors of ``window`` words and more are
duplicate spans.

At the boundaries of factors a window may still be a copy of a place that its seed does
not point to. Such windows, and those around the first occurrences that factors refer
to, are compared by the hash of all their words over all blocks. Together this finds
exactly the windows that also start earlier: a window and its earlier copy have the same
seed at the same distance, so either the seed's first occurrence holds the window, and
the factor or the comparison with that place shows it, or no copy lies in a factor and
all of them are compared.

Earlier means a smaller id, or the same id and an earlier word. Null texts have no
words; rows with a null id come after all others; rows with equal ids do not count as
earlier than each other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import blocks as bl
from tidemark.llm import text as tx

OWNERS, WINDOWS = 0, 1


@dataclass
class Block:
    """The words of a block's documents and their seeds."""

    ids: np.ndarray
    data: np.ndarray
    off: np.ndarray
    words: tx.Words
    hashes: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    #: Starts of whole windows, and the number (in ``seed``) of the seed each one picks.
    start: np.ndarray
    pick: np.ndarray
    #: Seeds: the word they begin at, and the hash.
    seed: np.ndarray
    key: np.ndarray


def read_block(table: pa.Table, window: int) -> Block:
    ids = bl.doc_ids(table.column("doc_id"))
    order = np.argsort(ids, kind="stable")
    column = tx.one_array(table.column("text"))
    data, off = tx.bytes_of(column.take(pa.array(order)))
    ids = ids[order]
    w = tx.words(data, off)
    parts = []
    for lo, hi in tx.slices(off):
        a, b = w.first[lo], w.first[hi]
        parts.append(tx.word_hashes(data[off[lo] : off[hi]], tx.Words(w.start[a:b] - off[lo], w.end[a:b] - off[lo], w.first[lo : hi + 1] - a)))
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    doc = w.text_of()
    place = np.arange(len(w)) - w.first[doc] if len(w) else np.zeros(0, np.int64)
    k = window // 2 + 1
    at, value = tx.picks(hashes, k, window - k + 1)
    start = np.flatnonzero(tx.whole_windows(w.first, window))
    at, value = at[start], value[start]
    new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    return Block(ids, data, off, w, hashes, doc, place, start, np.cumsum(new) - 1, at[new], value[new])


def _sent(keys: np.ndarray, doc: np.ndarray, place: np.ndarray, block: int, parts: int, kind: int) -> pa.Table:
    """The least (doc, place) of each key, to the parts of the keys."""
    least, _ = bl.least_by_key(keys, doc, place)
    keys, doc, place = keys[least], doc[least], place[least].astype(np.uint32)
    cuts = bl.cut_by_part(bl.part_of(keys, parts), parts)
    return bl.table_of([(p, block, kind, bl.pack(keys[a:b], doc[a:b], place[a:b])) for p, a, b in cuts])


def _answers(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
    (keys, doc, place), _ = bl.unpack([b for b, k in zip(bodies, kinds, strict=True) if k == kind], "<u8", "<i8", "<u4")
    order = np.argsort(keys, kind="stable")
    return keys[order], doc[order], place[order].astype(np.int64)


def _resolve(keys: np.ndarray, doc: np.ndarray, place: np.ndarray, told: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, the first (doc, place) of its key, and whether the key occurs again."""
    least, number = bl.least_by_key(keys, doc, place)
    times = np.bincount(number, minlength=len(least))
    first_doc, first_place, again = doc[least].copy(), place[least].copy(), times > 1
    names = keys[least]
    if len(told[0]) and len(names):
        at = np.minimum(np.searchsorted(told[0], names), len(told[0]) - 1)
        known = told[0][at] == names
        first_doc[known], first_place[known] = told[1][at[known]], told[2][at[known]]
        again |= known
    return first_doc[number], first_place[number], again[number]


@dataclass
class Factors:
    """Runs of seeds that refer to one place: word ranges and what they point to."""

    start: np.ndarray
    length: np.ndarray
    ref_doc: np.ndarray
    ref_place: np.ndarray


def parse(b: Block, owners: tuple, window: int) -> tuple[Factors, np.ndarray, np.ndarray]:
    """The factors of a block, which windows lie in a factor, and which to compare."""
    k = window // 2 + 1
    doc, place = b.ids[b.doc[b.seed]], b.place[b.seed]
    ref_doc, ref_place, again = _resolve(b.key, doc, place, owners)
    own = (ref_doc == doc) & (ref_place == place)
    copy = again & ~own
    shift = place - ref_place
    goes_on = np.zeros(len(b.seed), bool)
    if len(b.seed) > 1:
        goes_on[1:] = (
            copy[1:] & copy[:-1] & (b.doc[b.seed[1:]] == b.doc[b.seed[:-1]])
            & (ref_doc[1:] == ref_doc[:-1]) & (shift[1:] == shift[:-1]) & (b.seed[1:] - b.seed[:-1] <= k)
        )
    first = np.flatnonzero(copy & ~goes_on)
    number = np.cumsum(copy & ~goes_on) - 1
    members = np.flatnonzero(copy)
    last = np.zeros(len(first), np.int64)
    last[number[members]] = members
    length = b.seed[last] + k - b.seed[first] if len(first) else np.zeros(0, np.int64)
    factors = Factors(b.seed[first], length, ref_doc[first], ref_place[first])

    # A window picks a seed; if that seed is in a factor, the window may lie in it as a whole.
    inside = np.zeros(len(b.start), bool)
    compare = np.zeros(len(b.start), bool)
    if len(b.start):
        chosen = copy[b.pick]
        f = number[b.pick[chosen]]
        s = b.start[chosen]
        inside[chosen] = (s >= factors.start[f]) & (s + window <= factors.start[f] + factors.length[f])
        compare = again[b.pick] & ~inside
    return factors, inside, compare


def dedup_substrings(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the words
    left, joined by a space), kept_text, and the spans removed as (start, length) words.

    Removed is each word covered by a window of ``window`` words that also starts earlier.
    """
    at = bl.layout(docs, text)
    rows = bl.dealt(docs, at, doc_id, text)
    parts = at.parts

    def index(key: tuple, table: pa.Table) -> pa.Table:
        b = read_block(table, window)
        return _sent(b.key, b.ids[b.doc[b.seed]], b.place[b.seed], key[0].as_py(), parts, OWNERS)

    def compare(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return bl.table_of([])
        b = read_block(table, window)
        _, _, open_ = parse(b, _answers(told, OWNERS), window)
        start = b.start[open_]
        return _sent(tx.window_hashes(b.hashes, window)[start], b.ids[b.doc[start]], b.place[start], key[0].as_py(), parts, WINDOWS)

    def remove(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans", "n_factors")}
        if table.num_rows:
            b = read_block(table, window)
            factors, copied, open_ = parse(b, _answers(told, OWNERS), window)
            start = b.start[open_]
            doc, place = b.ids[b.doc[start]], b.place[start]
            first_doc, first_place, _ = _resolve(tx.window_hashes(b.hashes, window)[start], doc, place, _answers(told, WINDOWS))
            copied[open_] = (first_doc != doc) | (first_place != place)
            gone = tx.covered(len(b.words), b.start[copied], window)
            per_doc = np.bincount(b.doc[factors.start], minlength=len(b.ids))
            raw = b.data.tobytes()
            bounds = list(zip(b.words.start.tolist(), b.words.end.tolist(), strict=True))
            for i, (lo, hi) in enumerate(zip(b.words.first[:-1].tolist(), b.words.first[1:].tolist(), strict=True)):
                lost = gone[lo:hi]
                kept = b" ".join([raw[s:e] for (s, e), x in zip(bounds[lo:hi], lost.tolist(), strict=True) if not x])
                spans = []
                if lost.any():
                    turn = np.diff(np.r_[0, lost.astype(np.int8), 0])
                    on, off = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                    spans = [{"start": s, "length": n} for s, n in zip(on.tolist(), (off - on).tolist(), strict=True)]
                for c, v in zip(found, (int(b.ids[i]), hi - lo, int(lost.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), spans, int(per_doc[i])), strict=True):
                    found[c].append(v)
        ids = pa.array(found["doc_id"], pa.int64())
        return pa.table(
            {
                "doc_id": pc.if_else(pc.equal(ids, int(bl.NO_ID)), pa.scalar(None, pa.int64()), ids),
                "n_words": pa.array(found["n_words"], pa.int64()),
                "n_removed": pa.array(found["n_removed"], pa.int64()),
                "kept_sha256": pa.array(found["kept_sha256"], pa.string()),
                "kept_text": pa.array(found["kept_text"], pa.string()),
                "n_factors": pa.array(found["n_factors"], pa.int64()),
                "spans": pa.array(found["spans"], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
            }
        )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, n_factors long, spans array<struct<start:long,length:long>>"
    asked = rows.groupBy("block").applyInArrow(index, bl.MESSAGE)
    owners = bl.messages(bl.messages(asked, "part", parts).groupBy("part").applyInArrow(lambda t: bl.firsts(t, OWNERS), bl.MESSAGE), "block", at.blocks)
    asked = rows.groupBy("block").cogroup(owners.groupBy("block")).applyInArrow(compare, bl.MESSAGE)
    found = bl.messages(bl.messages(asked, "part", parts).groupBy("part").applyInArrow(lambda t: bl.firsts(t, WINDOWS), bl.MESSAGE), "block", at.blocks)
    told = bl.together(owners, found, at.blocks)
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, schema)
