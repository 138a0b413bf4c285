"""Substring dedup by a distributed sparse suffix array.

Suffixes start at winnowed positions, so that every string of ``span`` bytes holds the
start of one. A first exchange of gram hashes leaves those whose gram occurs elsewhere.
Each block sorts its remaining suffixes (``span`` bytes to the right, then the bytes to
the left read backwards), keeps equal ones once, and sends them front-coded: a length
shared with the one before, and the rest. Ranges of the order, cut at sampled
splitters, go to one part each. A part merges its runs with a loser tree that keeps, for
each run, how much its head shares with the last winner; heads are compared from there
on, never from the start, and often not at all.

The merged order, with the lengths shared by neighbours, is the suffix array of the
part. Suffixes that share their gram are neighbours; for each place a string can have
around the gram, those with equal bytes on both sides have the same string, and the
least id of these decides. What is sent back to a block is one bit for each place.

A string that also starts in a document with a smaller id is removed byte by byte;
overlaps count. Null is the empty text. Rows with a null id come after all others; rows
with equal ids do not count against each other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import blocks as bl
from tidemark.llm import text as tx

SEEN, RUNS, PLACES = 0, 1, 2
#: Pads a suffix beyond its text; no UTF-8 text has this byte.
PAD = 0xFF
#: Positions of a block that are looked at at once.
PIECE = 1 << 20
#: Suffixes whose strings are marked at once.
MARKED = 1 << 15
#: Documents that splitters are sampled from. Splitters only balance the parts.
SAMPLE_DOCS = 1000
_BYTE = tx.mix(np.arange(256, dtype=np.uint64) + np.uint64(77))


@dataclass(frozen=True)
class Shape:
    """How strings of ``span`` bytes are anchored: by the least of ``w`` grams of ``k`` bytes."""

    span: int

    @property
    def k(self) -> int:
        return max(1, self.span * 2 // 5)

    @property
    def w(self) -> int:
        return self.span - self.k + 1

    @property
    def lead(self) -> int:
        """Bytes that parts are cut by: inside the gram, whose suffixes must meet in one part."""
        return min(16, self.k)

    @property
    def left(self) -> int:
        return self.w - 1

    @property
    def width(self) -> int:
        return self.span + self.left


@dataclass
class Block:
    ids: np.ndarray
    data: np.ndarray
    off: np.ndarray
    #: Suffixes: where they start, their gram's hash, their document, and the first and last of
    #: the strings that pick them (a string's pick never lies before the one of an earlier string).
    at: np.ndarray
    gram: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray


def read_block(table: pa.Table, shape: Shape) -> Block:
    """What is kept of a block is its bytes and its suffixes, about one in sixteen of the
    positions; single positions are looked at piece by piece."""
    ids = bl.doc_ids(table.column("doc_id"))
    order = np.argsort(ids, kind="stable")
    data, off = tx.bytes_of(tx.one_array(table.column("text")).take(pa.array(order)))
    at, gram, first, last = _suffixes(data, off, shape)
    doc = np.searchsorted(off, at, "right").astype(np.int32) - np.int32(1)
    return Block(ids[order], data, off, at, gram, doc, first, last)


def _suffixes(data: np.ndarray, off: np.ndarray, shape: Shape, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, gram hash, first string, last string) of the suffixes that whole strings pick."""
    found: list[tuple[np.ndarray, ...]] = []
    whole = tx.whole_windows(off, shape.span)
    for a in range(0, len(whole), piece):
        b = min(len(whole), a + piece)
        start = np.flatnonzero(whole[a:b])
        if not len(start):
            continue
        at, gram = tx.picks(_BYTE[data[a : b + shape.span - 1]], shape.k, shape.w)
        at, gram = at[start], gram[start]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        end = np.r_[new[1:] - 1, len(at) - 1]
        found.append(((at[new] + a).astype(np.int32), gram[new], (start[new] + a).astype(np.int32), (start[end] + a).astype(np.int32)))
    if not found:
        none = np.zeros(0, np.int32)
        return none, np.zeros(0, np.uint64), none, none
    at, gram, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    # A suffix that is picked on both sides of a cut between pieces is one.
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[new], gram[new], first[new], last[np.r_[new[1:] - 1, len(at) - 1]]


def hash_bytes(count: int) -> int:
    """Bytes of a hash that keep chance hits near one in a thousand of ``count`` hashes."""
    return min(8, max(5, -(-(int(count).bit_length() + 10) // 8)))


def _short(gram: np.ndarray, size: int) -> np.ndarray:
    return gram >> np.uint64(64 - 8 * size)


def _local(b: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shortened hashes in order, each suffix's number in them, and which occur in
    several documents of the block."""
    short = _short(b.gram, size)
    names = np.sort(short)
    names = names[np.r_[True, names[1:] != names[:-1]]] if len(names) else names
    number = np.searchsorted(names, short)
    low = np.full(len(names), np.iinfo(np.int64).max)
    high = np.full(len(names), -1)
    np.minimum.at(low, number, b.doc)
    np.maximum.at(high, number, b.doc)
    return names, number, low != high


def _suffix_bytes(b: Block, which: np.ndarray, shape: Shape) -> np.ndarray:
    """(suffixes, width): bytes to the right, then those to the left backwards, padded."""
    padded = np.concatenate([np.full(shape.left, PAD, np.uint8), b.data, np.full(shape.span, PAD, np.uint8)])
    at = b.at[which] + shape.left
    view = np.lib.stride_tricks.sliding_window_view(padded, shape.left + shape.span)
    rows = view[at - shape.left]
    out = np.concatenate([rows[:, shape.left :], rows[:, : shape.left][:, ::-1]], axis=1)
    lo, hi = b.off[b.doc[which]], b.off[b.doc[which] + 1]
    right, left = hi - b.at[which], b.at[which] - lo
    cols = np.arange(shape.width)
    for i in np.flatnonzero((right < shape.span) | (left < shape.left)).tolist():
        out[i, (cols >= right[i]) & (cols < shape.span)] = PAD
        out[i, cols >= shape.span + left[i]] = PAD
    return out


def _shared(rows: np.ndarray) -> np.ndarray:
    """How many first bytes each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def sorted_suffixes(b: Block, which: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes in order, their shared lengths, the least document of each, and the
    number of each suffix of ``which`` among them."""
    rows = _suffix_bytes(b, which, shape)
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Sorted by eight bytes and place first; only ties of that are compared as strings.
    lead = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(lead, kind="stable")
    names = np.ascontiguousarray(rows).view(f"S{shape.width}").ravel()
    tied = np.flatnonzero(np.diff(np.r_[False, lead[order][1:] == lead[order][:-1], False].astype(np.int8)))
    for a, z in zip(tied[::2].tolist(), (tied[1::2] + 1).tolist(), strict=True):
        group = order[a:z]
        order[a:z] = group[np.argsort(names[group], kind="stable")]
    rows = rows[order]
    shared = _shared(rows)
    new = shared < shape.width
    new[0] = True
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(least, number, b.ids[b.doc[which]])
    # A suffix shares with the last distinct one what it shares with the row before it.
    return rows[new], shared[new], least, number


def front_code(rows: np.ndarray, doc: np.ndarray) -> bytes:
    """A run: shared lengths, documents, and the bytes that are not shared; compressed."""
    shared = _shared(rows)
    rest = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    body = bl.pack(shared.astype(np.uint8), doc) + rest.tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def read_run(body: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, shared lengths, documents) of a front-coded run."""
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    (shared, doc), counts = bl.unpack([raw], "u1", "<i8")
    n = int(counts[0])
    rest = np.frombuffer(raw, np.uint8, offset=8 + 9 * n)
    shared = shared.astype(np.int64)
    rows = np.empty((n, width), np.uint8)
    rows[np.arange(width)[None, :] >= shared[:, None]] = rest
    index = np.arange(n)
    for c in range(int(shared.max(initial=0))):
        # The byte of the last row that brought its own.
        rows[:, c] = rows[np.maximum.accumulate(np.where(shared <= c, index, 0)), c]
    return rows, shared, doc


def merge_runs(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int]]:
    """Merge sorted runs of (strings, lengths shared with the one before) by a loser tree.

    Returns the run of each merged string, and the length it shares with the one merged
    before it. An inner node keeps the head that lost there and how much it shares with
    the head that won; a larger share with the last winner means a smaller string, so
    bytes are read only where the shares are equal, and only beyond them.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    at = [0] * size
    heads: list[bytes | None] = [runs[i][0][0] if i < k and runs[i][0] else None for i in range(size)]
    loser, lost = [0] * size, [0] * size
    done = -1  # the share of a run that has ended: it loses against all others

    def play(x: int, hx: int, y: int, hy: int) -> tuple[int, int, int, int]:
        """(winner, its share, loser, its share) of heads with shares to the same string."""
        if hx > hy:
            return x, hx, y, hy
        if hy > hx:
            return y, hy, x, hx
        if hx == done:
            return x, done, y, done
        a, b, h = heads[x], heads[y], hx
        if a[h:] == b[h:]:
            return (x, hx, y, width) if x < y else (y, hy, x, width)
        while a[h : h + 8] == b[h : h + 8]:
            h += 8
        while a[h] == b[h]:
            h += 1
        return (x, hx, y, h) if a[h] < b[h] else (y, hy, x, h)

    # First round: all shares are with the empty string.
    level = [(i, 0 if heads[i] is not None else done) for i in range(size)]
    first = size
    while len(level) > 1:
        first //= 2
        up = []
        for i in range(0, len(level), 2):
            w, hw, x, hx = play(*level[i], *level[i + 1])
            loser[first + i // 2], lost[first + i // 2] = x, hx
            up.append((w, hw))
        level = up
    winner, share = level[0]

    out_run, out_share = [], []
    while share != done:
        out_run.append(winner)
        out_share.append(share)
        strings, shared = runs[winner]
        i = at[winner] = at[winner] + 1
        if i < len(strings):
            heads[winner], share = strings[i], shared[i]
        else:
            share = done
        node = (winner + size) >> 1
        while node:
            other, theirs = loser[node], lost[node]
            if theirs > share:
                loser[node], lost[node], winner, share = winner, share, other, theirs
            elif theirs == share and share != done:
                winner, share, loser[node], lost[node] = play(winner, share, other, theirs)
            node >>= 1
    return out_run, out_share


def places(rows: np.ndarray, shared: np.ndarray, doc: np.ndarray, shape: Shape) -> np.ndarray:
    """For merged suffixes: a bit for each place o such that the string from o bytes before the
    suffix also occurs around one with a smaller document."""
    n = len(rows)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    everywhere = np.uint64((1 << shape.w) - 1)
    equal = np.cumsum(shared < shape.width) - 1
    gram = np.cumsum(shared < shape.k) - 1
    first = np.flatnonzero(np.r_[True, equal[1:] != equal[:-1]])
    least = np.minimum.reduceat(doc, first)
    out[doc > least[equal]] = everywhere
    # Grams with several distinct suffixes: compare every place by a hash of its two sides.
    kinds = np.bincount(gram[first])
    multi = first[kinds[gram[first]] > 1]
    if not len(multi):
        return out
    text, low, group = rows[multi], least[equal[multi]], gram[multi].astype(np.uint64)
    factor = np.uint64(0x9FB21C651E98DF25)
    right = np.zeros((shape.span + 1, len(multi)), np.uint64)
    for c in range(shape.span):
        right[c + 1] = (right[c] + _BYTE[text[:, c]]) * factor
    left = np.zeros(len(multi), np.uint64)
    bits = np.zeros(len(multi), np.uint64)
    seed = tx.mix(group + np.uint64(5))
    for o in range(shape.w):
        key = tx.mix(tx.mix(right[shape.span - o] ^ seed) + left)
        by = np.argsort(key, kind="stable")
        ordered = key[by]
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        best = np.empty(len(multi), np.int64)
        best[by] = np.repeat(np.minimum.reduceat(low[by], start), np.diff(np.r_[start, len(by)]))
        bits |= (best < low).astype(np.uint64) << np.uint64(o)
        if o < shape.left:
            left = (left + _BYTE[text[:, shape.span + o]]) * factor
    # Copies of a suffix in later documents have every place already.
    of = np.full(int(equal[-1]) + 1, 0, np.uint64)
    of[equal[multi]] = bits
    return np.where(doc > least[equal], out, of[equal])


def _seen(table: pa.Table, parts: int, size: int) -> pa.Table:
    """Answers which of the hashes that blocks sent came from several blocks."""
    bodies, senders = table.column("body").to_pylist(), table.column("block").to_pylist()
    lists = [np.frombuffer(b, np.uint8).reshape(-1, size) for b in bodies]
    counts = [len(x) for x in lists]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, :size] = np.concatenate(lists) if lists else 0
    keys = wide.view("<u8").ravel()
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    out, lo = [], 0
    for sender, n in zip(senders, counts, strict=True):
        mine = keys[lo : lo + n]
        # Both are in order: one merge pass finds the members.
        found = np.searchsorted(twice, mine, "right") > np.searchsorted(twice, mine, "left")
        out.append((sender, int(table.column("part")[0].as_py()), SEEN, n.to_bytes(8, "little") + np.packbits(found).tobytes()))
        lo += n
    return bl.table_of(out)


def _copied(b: Block, mask: np.ndarray) -> np.ndarray:
    """Which positions begin a string that is removed: ``mask`` has a bit for each place that
    a string can have before its suffix."""
    out = np.zeros(len(b.data), bool)
    which = np.flatnonzero(mask)
    for a in range(0, len(which), MARKED):
        some = which[a : a + MARKED]
        length = (b.last[some] - b.first[some] + 1).astype(np.int64)
        start = tx.ranges(b.first[some].astype(np.int64), length)
        before = (np.repeat(b.at[some], length) - start).astype(np.uint64)
        out[start] = (np.repeat(mask[some], length) >> before & np.uint64(1)).astype(bool)
    return out


def _covered(starts: np.ndarray, span: int) -> np.ndarray:
    """Which positions of a text lie in a string of ``span`` that begins at one of ``starts``."""
    if not starts.any():
        return np.zeros(len(starts), bool)
    begun = np.cumsum(starts, dtype=np.int32)
    ended = np.zeros_like(begun)
    ended[span:] = begun[:-span]
    return begun > ended


def _by_part(told: pa.Table, kind: int) -> list[bytes]:
    rows = zip(told.column("from").to_pylist(), told.column("kind").to_pylist(), told.column("body").to_pylist(), strict=True)
    return [body for _, k, body in sorted((r for r in rows if r[1] == kind), key=lambda r: r[0])]


def _candidates(b: Block, told: pa.Table, size: int) -> np.ndarray:
    names, number, local = _local(b, size)
    flags = [np.unpackbits(np.frombuffer(x, np.uint8, offset=8))[: int.from_bytes(x[:8], "little")] for x in _by_part(told, SEEN)]
    abroad = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
    return np.flatnonzero((abroad | local)[number]) if len(names) else np.zeros(0, np.int64)


def _part_cuts(rows: np.ndarray, splitters: list[bytes], shape: Shape) -> np.ndarray:
    """The part of each sorted suffix."""
    lead = np.ascontiguousarray(rows[:, : shape.lead]).view(f"S{shape.lead}").ravel()
    return np.searchsorted(np.array(splitters, f"S{shape.lead}"), lead, "right") if splitters else np.zeros(len(rows), np.int64)


def splitters(docs: DataFrame, parts: int, shape: Shape, doc_id: str = "doc_id", text: str = "text") -> list[bytes]:
    """Leading bytes that cut the suffixes of a bounded sample of documents in equal parts."""
    total = docs.count()
    some = docs.where(F.pmod(F.xxhash64(F.lit(3), doc_id), F.lit(max(1, total // SAMPLE_DOCS))) == 0)
    # The first bytes of a text are no better or worse than others for balance alone.
    texts = [r[0].encode() for r in some.where(F.col(text).isNotNull()).select(F.substring(text, 1, 4096)).limit(2 * SAMPLE_DOCS).collect()]
    leads = []
    for raw in texts:
        at, _, _, _ = _suffixes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), shape)
        leads += [raw[p : p + shape.lead] for p in at.tolist()]
    leads.sort()
    return sorted({leads[len(leads) * i // parts] for i in range(1, parts)}) if len(leads) > parts else []


def dedup_suffixes(docs: DataFrame, span: int = 50, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: the columns ``carry``, doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and kept_text (of the bytes left; runs can cut a character, whose rest
    is then dropped from kept_text alone)."""
    if not 5 <= span <= 100:
        raise ValueError("span must be from 5 to 100")
    shape = Shape(span)
    at = bl.layout(docs, text)
    rows = bl.dealt(docs, at, doc_id, text, carry)
    parts = at.parts
    kept_types = [rows.schema[f"_{i}"] for i in range(len(carry))]
    size = hash_bytes(at.blocks * bl.LEAST_BLOCK // 16)
    cuts = splitters(docs, parts, shape, doc_id, text)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        tx.release()
        names, _, _ = _local(read_block(table, shape), size)
        raw = names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        full = names << np.uint64(64 - 8 * size)
        return bl.table_of([(p, key[0].as_py(), SEEN, raw[a:z].tobytes()) for p, a, z in bl.cut_by_part(bl.part_of(full, parts), parts)])

    def seen(table: pa.Table) -> pa.Table:
        tx.release()
        return _seen(table, parts, size)

    def send(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        tx.release()
        if not table.num_rows:
            return bl.table_of([])
        b = read_block(table, shape)
        found, _, least, _ = sorted_suffixes(b, _candidates(b, told, size), shape)
        part = _part_cuts(found, cuts, shape) if len(found) else np.zeros(0, np.int64)
        return bl.table_of([(p, key[0].as_py(), RUNS, front_code(found[a:z], least[a:z])) for p, a, z in bl.cut_by_part(part, parts)])

    def merge(table: pa.Table) -> pa.Table:
        tx.release()
        senders = table.column("block").to_pylist()
        runs = [read_run(x, shape.width) for x in table.column("body").to_pylist()]
        strings = [(np.ascontiguousarray(r).view(f"V{shape.width}").ravel().tolist(), s.tolist()) for r, s, _ in runs]
        order, shared = merge_runs(strings, shape.width)
        order, shared = np.array(order, np.int64), np.array(shared, np.int64)
        # Where each run's strings went: merging keeps the order inside a run.
        counts = np.array([len(d) for _, _, d in runs])
        to = np.argsort(order, kind="stable")
        place = np.empty(len(order), np.int64)
        place[to] = np.arange(len(order))
        text_ = np.concatenate([r for r, _, _ in runs])[place]
        doc = np.concatenate([d for _, _, d in runs])[place]
        bits = places(text_, shared, doc, shape)[to]
        ends = np.cumsum(counts)
        me = int(table.column("part")[0].as_py())
        return bl.table_of([(s, me, PLACES, bl.pack(bits[e - n : e])) for s, n, e in zip(senders, counts.tolist(), ends.tolist(), strict=True)])

    def remove(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        tx.release()
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
        out: dict[str, list] = {c: [] for c in names}
        order = pa.array(np.argsort(bl.doc_ids(table.column("doc_id")), kind="stable"))
        carried = {f"_{i}": table.column(f"_{i}").take(order) for i in range(len(carry))}
        if table.num_rows:
            b = read_block(table, shape)
            which = _candidates(b, told, size)
            _, _, least, number = sorted_suffixes(b, which, shape)
            (bits,), _ = bl.unpack(_by_part(told, PLACES), "<u8")
            mask = np.zeros(len(b.at), np.uint64)
            later = b.ids[b.doc[which]] > least[number]
            mask[which] = np.where(later, np.uint64((1 << shape.w) - 1), bits[number] if len(number) else np.uint64(0))
            copied = _copied(b, mask)
            for i, (lo, hi) in enumerate(zip(b.off[:-1].tolist(), b.off[1:].tolist(), strict=True)):
                lost = _covered(copied[lo:hi], span)
                kept = b.data[lo:hi][~lost].tobytes()
                spans = int((lost[1:] & ~lost[:-1]).sum() + lost[:1].sum())
                for c, v in zip(names, (int(b.ids[i]), hi - lo, int(lost.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), strict=True):
                    out[c].append(v)
        ids = pa.array(out["doc_id"], pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        rest = {c: pa.array(out[c], t) for c, t in zip(names[1:], kinds, strict=True)}
        return pa.table({**carried, "doc_id": pc.if_else(pc.equal(ids, int(bl.NO_ID)), pa.scalar(None, pa.int64()), ids), **rest})

    def answers(found: DataFrame) -> DataFrame:
        """Answers at their blocks; a part names itself as the sender."""
        return found.select(F.col("target").alias("block"), F.col("block").alias("from"), "kind", "body").repartitionById(
            at.blocks, F.col("block")
        )

    asked = rows.groupBy("block").applyInArrow(ask, bl.MESSAGE)
    known = answers(bl.messages(asked, "part", parts).groupBy("part").applyInArrow(seen, bl.MESSAGE))
    sent = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send, bl.MESSAGE)
    found = answers(bl.messages(sent, "part", parts).groupBy("part").applyInArrow(merge, bl.MESSAGE))
    found_types = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    schema = T.StructType([*kept_types, *T.StructType.fromDDL(found_types).fields])
    told = bl.together(known, found, at.blocks)
    done = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, schema)
    return done.withColumnsRenamed({f"_{i}": name for i, name in enumerate(carry)})
