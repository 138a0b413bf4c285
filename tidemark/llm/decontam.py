"""Benchmark decontamination by latent semantic retrieval.

Documents are read once, for any number of items: what is kept of a text are the places
of words that occur in the benchmark. Cells of ``CELL`` words make passages of two
neighbouring cells each. Passages are TF-IDF vectors with document counts from the whole
corpus. A randomised singular value decomposition finds their main directions, fewer than
there are pieces: the matrix of passages is multiplied with a random one in one pass, and
with the orthonormal basis of that in another; only sums over passages, as large as the
vocabulary, leave a task. The space is fitted on the passages of all documents; benchmark
pieces are rows of the matrix too, weighted up to the weight of the passages. Every document
is searched.

Each piece is compared with the windows of a text that have its own length and begin at
one of its words. A window is a candidate if it holds ``SHARE`` of the piece's words, and
its latent vector has a cosine of ``NEAR`` or more with the piece's, or has that share of
the piece's own length. Words unknown to the
benchmark have no weight, so neither words around a copy nor the number of documents
decide. All candidates are compared: a candidate's surroundings with the whole item, by
longest common subsequence of words. It is a leak if the item is covered by ``verbatim``, or
as a paraphrase, by ``paraphrase`` with the item's answer (its last fifth, three words at
least) found in order as well.

Copies word for word are found by the item's sequence of words alone, whatever its
length and however common its words: at each occurrence of its rarest word, hashes of
runs of words are compared. So an item of one word leaks into every document that has it.

Cases: null texts and null items hold nothing, nor do items without a word. Paraphrases of
items with fewer than ``LEAST_WORDS`` words are not looked for. Texts and words of any
length are searched whole. Of several places of an item, the one that covers most (then
the first) is reported. Rows of documents with equal ids, null among them, count as one
document in the result; items with equal ids as one item. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.licenses import plain_words
from tidemark.llm.scratch import Scratch

CELL = 16
#: Pieces for each direction of the space, and the most directions; the basis has some more
#: while it is found.
PIECES_EACH, MOST_RANK, EXTRA = 2, 256, 16
#: While the space is fitted, a task sums products over so many bytes of packed words once
#: there are more than ``FIT_TASKS`` tasks: a sum is as large as the vocabulary.
FIT_BYTES, FIT_TASKS = 256 << 20, 256
#: Weight of all pieces against that of all passages when the space is found.
PIECES = 10.0
NEAR = 0.33
#: Share of a piece's words in a window: half of them, spread over twice the piece's length.
SHARE = 0.25
#: Words in more than this share of documents don't count for retrieval (they do for coverage).
COMMON = 0.5
LEAST_WORDS = 5
#: Share of a paraphrased item's answer that is found in order.
ANSWER = 0.8
#: Items whose documents are read in one go, and items searched in one go over what was read.
READ_ITEMS, ITEMS = 30_000, 300
#: Vectors of a run that are added one after the other.
RUN = 32
#: Words, and windows, that are looked at at once.
WINDOWS = 1 << 14
#: Words of surroundings that are compared at once.
PLACES = 1 << 19
_BLOCK = 64
_LEAKS = "doc_id long, item_id long, cosine double, coverage double, answer double, word_start long"


@dataclass
class Items:
    """Benchmark items as numbers of a vocabulary of word hashes."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    #: Pieces: the item, and the first and last place of it.
    piece_item: np.ndarray
    piece_from: np.ndarray
    piece_to: np.ndarray


def some_items(items: Items, which: range) -> tuple[Items, np.ndarray]:
    """A block of items with a vocabulary of its own, and the number there of each word of the
    whole vocabulary (-1: none)."""
    ids, words = [items.ids[i] for i in which], [items.words[i] for i in which]
    own = np.unique(np.concatenate([np.zeros(0, np.int32), *words]))
    to = np.full(len(items.vocabulary), -1, np.int32)
    to[own] = np.arange(len(own))
    mine = (items.piece_item >= which.start) & (items.piece_item < which.stop)
    pieces = (items.piece_item[mine] - which.start, items.piece_from[mine], items.piece_to[mine])
    return Items(ids, [to[x] for x in words], items.vocabulary[own], *pieces), to


def read_items(rows: list[tuple[int, str]]) -> Items:
    """Items of (id, lower-cased text)."""
    data, off = tx.bytes_of(pa.array([r[1] for r in rows], pa.string()))
    w, hashes = plain_words(data, off)
    ids, words = [], []
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b > a:
            ids.append(rows[i][0])
            words.append(hashes[a:b])
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    pieces = []
    for i, x in enumerate(words):
        parts = -(-len(x) // CELL) if len(x) >= LEAST_WORDS else 0
        for p in range(parts):
            # Pieces of equal length, the last one from the end, so that none is short.
            size = min(CELL, len(x))
            start = min(p * CELL, len(x) - size)
            pieces.append((i, start, start + size))
    item, begin, end = map(np.array, zip(*pieces, strict=True)) if pieces else (np.zeros(0, int),) * 3
    return Items(ids, [np.searchsorted(vocabulary, x).astype(np.int32) for x in words], vocabulary, item, begin, end)


def find_words(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, text) to (doc_id, places, words): packed places and numbers of the
    vocabulary's words, for texts that have any."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << 20, bool)
        bits[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            data, off = tx.bytes_of(batch.column(1))
            for lo, hi in tx.slices(off, 1 << 20):
                w, hashes = plain_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                maybe = np.flatnonzero(bits[(hashes >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
                hit = vocabulary[at] == hashes[maybe]
                where, word = maybe[hit], at[hit].astype(np.int32)
                cut = np.searchsorted(where, w.first)
                rows = np.flatnonzero(np.diff(cut))
                places = [(where[cut[i] : cut[i + 1]] - w.first[i]).astype(np.int32).tobytes() for i in rows]
                words = [word[cut[i] : cut[i + 1]].tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), pa.array(places, pa.binary()), pa.array(words, pa.binary())],
                    names=["doc_id", "places", "words"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.lower("text").alias("text"))
    return rows.mapInArrow(found, "doc_id long, places binary, words binary")


@dataclass
class Cells:
    """Cells of a batch that have words: the rows of their words, where those of each cell
    begin, and whether a cell and the next make a passage. A passage begins at each cell."""

    word: np.ndarray
    first: np.ndarray
    pair: np.ndarray


@dataclass
class Found:
    """All words of a batch's documents, by document and place."""

    place: np.ndarray
    word: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray


def read_found(batch: pa.RecordBatch, to: np.ndarray | None = None) -> Found:
    """All found words, or with ``to`` those that have a number there."""
    places, words = batch.column("places").to_pylist(), batch.column("words").to_pylist()
    place, word = np.frombuffer(b"".join(places), np.int32), np.frombuffer(b"".join(words), np.int32)
    bounds = np.r_[0, np.cumsum([len(x) // 4 for x in places])].astype(np.int64)
    doc = np.repeat(np.arange(len(places)), np.diff(bounds))
    if to is not None:
        word = to[word]
        kept = np.flatnonzero(word >= 0)
        place, word, doc = place[kept], word[kept], doc[kept]
        bounds = np.searchsorted(kept, bounds)
    return Found(place, word, bounds, doc)


def read_cells(batch: pa.RecordBatch, to: np.ndarray) -> Cells:
    f = read_found(batch, to)
    doc, cell = f.doc, f.place // CELL
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])]) if len(doc) else np.zeros(0, np.int64)
    own, at = doc[new], cell[new]
    pair = np.r_[(own[1:] == own[:-1]) & (at[1:] == at[:-1] + 1), False][: len(new)]
    return Cells(f.word, new, pair)


def inverse_frequencies(counts: np.ndarray, documents: int) -> np.ndarray:
    return np.where(counts <= COMMON * documents, np.log((documents + 1) / (counts + 0.5)), 0.0)


def _sums(vectors: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the vectors ``of`` each run; runs begin at ``first``, none is empty.

    All runs add their next vector at once, the longest first: whole rows are added, which
    is several times faster than reducing run by run. Runs of over ``RUN`` vectors are summed
    in parts, and the parts as runs again.
    """
    if not len(first):
        return np.zeros((0, vectors.shape[1]), np.float32)
    length = np.diff(np.r_[first, len(of)])
    if length.max() > RUN:
        parts = -(-length // RUN)
        begin = np.r_[0, np.cumsum(parts)[:-1]]
        inside = np.arange(parts.sum()) - np.repeat(begin, parts)
        some = _sums(vectors, of, np.repeat(first, parts) + RUN * inside)
        return _sums(some, np.arange(len(some)), begin)
    order = np.argsort(-length, kind="stable")
    length, first = length[order], first[order]
    out = vectors[of[first]]
    row = np.empty_like(out)
    for j in range(1, int(length[0])):
        more = int(np.searchsorted(-length, -j, "left"))
        out[:more] += np.take(vectors, of[first[:more] + j], axis=0, out=row[:more], mode="clip")
    row[order] = out
    return row


def _each_batch(batches: Iterator[pa.RecordBatch], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the vectors of all words of one fit in some tens of megabytes."""
    for batch in batches:
        bounds = np.r_[0, np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False))]
        for lo, hi in tx.slices(bounds, size):
            yield batch.slice(lo, hi - lo)


def _summed(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """(block, body) matrices of ``_BLOCK`` rows each, summed on Spark; the sum comes to the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("body").to_pylist())
        return pa.table({"block": table.column("block")[:1], "body": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = np.zeros((-(-rows // _BLOCK) * _BLOCK, width))
    for r in parts.groupBy("block").applyInArrow(add, "block int, body binary").collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["body"], np.float32).reshape(-1, width)
    return out[:rows]


def total_bytes(hits: DataFrame) -> int:
    return int(hits.agg(F.sum(F.octet_length("words").cast("bigint"))).first()[0] or 0)


def document_counts(hits: DataFrame, size: int) -> np.ndarray:
    """In how many documents each word of the vocabulary occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            for x in words:
                total[np.unique(np.frombuffer(x, np.int32))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for r in hits.select("words").mapInArrow(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _product(hits: DataFrame, to: np.ndarray, idf: np.ndarray, right: np.ndarray, gram: bool) -> np.ndarray:
    """Over all passages X: X'(X right), or with ``gram`` right'X'X right."""
    vectors = (idf[:, None] * right).astype(np.float32)
    size, width = right.shape

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = -(-(width if gram else size) // _BLOCK) * _BLOCK
        total = np.zeros((rows, width), np.float64 if gram else np.float32)
        for batch in _each_batch(batches):
            c = read_cells(batch, to)
            if not len(c.first):
                continue
            # Each word is added once, to its cell; a passage is the sum of its cells.
            y = _sums(vectors, c.word, c.first)
            y[:-1] += np.where(c.pair[:-1, None], y[1:], np.float32(0))
            if gram:
                total[:width] += y.T @ y
                continue
            # A cell's words are in the passage that begins at it, and in the one before.
            of_cell = y.copy()
            of_cell[1:] += np.where(c.pair[:-1, None], y[:-1], np.float32(0))
            cell = np.repeat(np.arange(len(c.first)), np.diff(np.r_[c.first, len(c.word)]))
            order = np.argsort(c.word, kind="stable")
            word, cell = c.word[order], cell[order]
            new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            total[word[new]] += idf[word[new], None] * _sums(of_cell, cell, new)
        blocks = total.reshape(-1, _BLOCK, width)
        filled = np.flatnonzero(np.abs(blocks).sum(axis=(1, 2)))
        body = pa.array([blocks[i].astype(np.float32).tobytes() for i in filled], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), body], names=["block", "body"])

    found = hits.select("places", "words").mapInArrow(product, "block int, body binary")
    return _summed(found, width if gram else size, width)


def latent_space(hits: DataFrame, items: Items, to: np.ndarray, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """(vocabulary, rank): main right singular vectors of passages and pieces."""
    size = len(items.vocabulary)
    rank = max(1, min(MOST_RANK, -(-len(items.piece_item) // PIECES_EACH)))
    width = min(rank + EXTRA, size)
    pieces = piece_vectors(items, idf)
    start = np.random.default_rng(seed).standard_normal((size, width))
    corpus = _product(hits, to, idf, start, gram=False)
    own = pieces.T @ (pieces @ start)
    scale = PIECES * np.linalg.norm(corpus) / max(np.linalg.norm(own), 1e-12) if np.abs(corpus).any() else 1.0
    basis, _ = np.linalg.qr(corpus + scale * own)
    inner = _product(hits, to, idf, basis, gram=True)
    half = pieces @ basis
    values, vectors = np.linalg.eigh(inner + scale * half.T @ half)
    return basis @ vectors[:, np.argsort(values)[::-1][: min(rank, width)]]


def piece_vectors(items: Items, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items.piece_item), len(items.vocabulary)))
    for row, (i, a, b) in enumerate(zip(items.piece_item, items.piece_from, items.piece_to, strict=True)):
        np.add.at(out[row], items.words[i][a:b], idf[items.words[i][a:b]])
    return out


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    at: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        at[word] = at.get(word, 0) | (1 << i)
    whole = (1 << len(item)) - 1
    row = whole
    for word in text.tolist():
        same = row & at.get(word, 0)
        row = ((row + same) | (row - same)) & whole
    return len(item) - row.bit_count()


@dataclass
class Pieces:
    """Pieces as tasks need them."""

    size: np.ndarray
    #: Least number of own words in a window.
    least: np.ndarray
    #: Pieces by size and least number, and where those begin that are alike in both (and the end).
    order: np.ndarray
    alike: np.ndarray
    #: Pieces that hold a word: those of word w are keys[first[w] : first[w + 1]], as places in
    #: ``order`` above ``_KEY`` bits for a place in the text.
    first: np.ndarray
    keys: np.ndarray
    length: np.ndarray
    #: (vocabulary, piece): what a word adds to the product with the piece's unit latent vector.
    adds: np.ndarray
    #: More than a sum of these in short numbers loses.
    slack: float


#: Bits for the places of words that are looked at at once; wider gaps count as ``CELL`` + 1.
_KEY = ((WINDOWS + CELL + 1) * (CELL + 1)).bit_length()


def prepare(items: Items, idf: np.ndarray, space: np.ndarray) -> Pieces:
    vectors = piece_vectors(items, idf)
    latent = vectors @ space
    unit = latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]
    adds = ((idf[:, None] * space) @ unit.T).astype(np.float32)
    word, piece = np.nonzero(vectors.T)
    # Words without weight are not counted.
    counted = np.array([(idf[items.words[i][a:b]] > 0).sum() for i, a, b in zip(items.piece_item, items.piece_from, items.piece_to, strict=True)])
    first = np.searchsorted(word, np.arange(len(items.vocabulary) + 1))
    least = np.maximum(1, np.ceil(SHARE * counted)).astype(np.int64)
    size = items.piece_to - items.piece_from
    order = np.lexsort((least, size))
    alike = np.flatnonzero(np.r_[True, (np.diff(size[order]) != 0) | (np.diff(least[order]) != 0), True]) if len(order) else np.zeros(1, np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Short keys are sorted twice as fast.
    keys = (rank[piece] << _KEY).astype(np.uint32 if len(order) << _KEY <= 1 << 32 else np.uint64)
    return Pieces(size, least, order, alike, first, keys, np.linalg.norm(vectors, axis=1), adds, 1e-4 * float(np.abs(adds).max(initial=0)))


def _likes(word: np.ndarray, begin: np.ndarray, n: np.ndarray, piece: np.ndarray, p: Pieces) -> np.ndarray:
    """Products of windows of ``n`` words with pieces, in short numbers: all windows add their
    next word at once, the longest first."""
    order = np.argsort(-n.astype(np.int8), kind="stable")
    longest, base = n[order], word.astype(np.int64) * len(p.size)
    begin, piece, adds = begin[order], piece[order], p.adds.ravel()
    out = adds[base[begin] + piece]
    for j in range(1, int(longest[0])):
        more = int(np.searchsorted(-longest, -j, "left"))
        out[:more] += adds[base[begin[:more] + j] + piece[:more]]
    like = np.empty_like(out)
    like[order] = out
    return like


def near_windows(f: Found, p: Pieces, idf: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the first word, piece, cosine) of all windows near a piece."""
    out = []
    if not len(p.size) or not len(f.word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # Places that run on from document to document, with gaps wider than a window.
    step = np.where(np.diff(f.doc) != 0, CELL + 1, np.minimum(np.diff(f.place), CELL + 1))
    place = np.r_[0, np.cumsum(step, dtype=np.int64)]
    sizes, sized = np.unique(p.size, return_inverse=True)
    adds, squares = p.adds.ravel(), idf**2
    for a in range(0, len(place), WINDOWS):
        # Windows that begin here may end in the next chunk.
        z, until = min(a + WINDOWS, len(place)), min(a + WINDOWS + CELL, len(place))
        word, here = f.word[a:until], place[a:until] - place[a]
        n = p.first[word + 1] - p.first[word]
        upto = np.cumsum(n)
        at = np.arange(upto[-1]) + np.repeat(p.first[word] - upto + n, n)
        key = np.sort(p.keys[at] | np.repeat(here.astype(p.keys.dtype), n))
        # Pieces that ask as many words of as long a window are neighbours.
        ends = np.searchsorted(key, (p.alike[1:-1] << _KEY).astype(key.dtype))
        kept = []
        for some, i in zip(np.split(key, ends), p.order[p.alike[:-1]].tolist(), strict=True):
            more = int(p.least[i]) - 1
            kept.append(some[: max(0, len(some) - more)][some[more:] - some[: max(0, len(some) - more)] < p.size[i]])
        key = np.concatenate(kept).astype(np.int64)
        # How many words stand before each place.
        before = np.zeros(int(here[-1]) + CELL + 2, np.int64)
        before[here + 1] = 1
        before = np.cumsum(before)
        begin, piece = before[key & ((1 << _KEY) - 1)], p.order[key >> _KEY]
        own = begin < z - a
        begin, piece = begin[own], piece[own]
        # Where windows of each size end, for each word that they may begin at.
        ends = np.array([before[here + size] for size in sizes])
        sums = np.r_[0, np.cumsum(squares[word])]
        found = []
        for lo in range(0, len(begin), WINDOWS):
            b, q = begin[lo : lo + WINDOWS], piece[lo : lo + WINDOWS]
            n = ends[sized[q], b] - b
            # Equal words lengthen a window further; those that fail before that need not be looked at.
            norm = np.sqrt(np.maximum(sums[b + n] - sums[b] - 1e-6, 0))
            maybe = np.flatnonzero(_likes(word, b, n, q, p) + p.slack >= near * np.minimum(norm, p.length[q]))
            if not len(maybe):
                continue
            b, q, n = b[maybe], q[maybe], n[maybe]
            inside, start = word[tx.ranges(b, n)].astype(np.int64), np.r_[0, np.cumsum(n)[:-1]]
            like = np.add.reduceat(adds[inside * len(p.size) + np.repeat(q, n)].astype(np.float64), start)
            pairs, times = np.unique((np.repeat(np.arange(len(b)), n) << 32) | inside, return_counts=True)
            norm = np.sqrt(np.bincount(pairs >> 32, (times * idf[pairs & ((1 << 32) - 1)]) ** 2, len(b)))
            kept = like >= near * np.minimum(norm, p.length[q])
            found.append((a + b[kept], q[kept], (like / np.maximum(norm, 1e-9))[kept]))
        if found:
            row, piece, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((row, piece))
            out.append((row[order], piece[order], cosine[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Times:
    """How often items, and their answers, hold their words, by ``item << 32 | word``; and how
    many words both have."""

    key: np.ndarray
    times: np.ndarray
    in_answer: np.ndarray
    size: np.ndarray
    answer: np.ndarray


def word_times(items: Items) -> Times:
    size = np.array([len(x) for x in items.words], np.int64)
    answer = np.minimum(size, np.maximum(3, size // 5))
    key = (np.repeat(np.arange(len(size)), size) << 32) | np.concatenate([np.zeros(0, np.int64), *items.words])
    key, at, times = np.unique(key, return_inverse=True, return_counts=True)
    ends = np.cumsum(size)
    return Times(key, times, np.bincount(at[tx.ranges(ends - answer, answer)], minlength=len(key)), size, answer)


def _compare_all(
    f: Found, items: Items, held: np.ndarray, t: Times, doc: np.ndarray, item: np.ndarray, middle: np.ndarray, verbatim: float, paraphrase: float
) -> Iterator[tuple[int, float, float, int]]:
    """(candidate, coverage, answer, start) of the surroundings that hold most of an item, for
    each document and item that is a leak. Candidates come by document, item and middle."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else np.zeros(0, np.int64)
    ends, n = np.r_[new[1:], len(doc)], f.bounds[doc[new] + 1] - f.bounds[doc[new]]
    for one, two in tx.slices(np.r_[0, np.cumsum(n)], PLACES):
        # The items' words in each document: pair of document and item, place and word.
        pair = np.repeat(np.arange(one, two), n[one:two])
        row = tx.ranges(f.bounds[doc[new[one:two]]], n[one:two])
        own = held[item[new[pair]], f.word[row]]
        pair, word, place = pair[own], f.word[row[own]].astype(np.int64), f.place[row[own]]
        where = (pair << 32) | place
        which = np.arange(new[one], ends[two - 1])
        of = np.repeat(np.arange(one, two), (ends - new)[one:two])
        reach = t.size[item[which]] + CELL
        lo, hi = np.searchsorted(where, (of << 32) + middle[which] - reach), np.searchsorted(where, (of << 32) + middle[which] + reach)
        order = np.lexsort((-hi, lo, of))
        which, of, lo, hi = which[order], of[order], lo[order], hi[order]
        # Surroundings that lie in others hold no more than those.
        widest = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (hi[1:] > np.maximum.accumulate(hi)[:-1])])
        which, of, lo, hi = which[widest], of[widest], lo[widest], hi[widest]
        best: dict[int, tuple[int, float, float, int]] = {}
        for k in _may_hold(word, lo, hi, item[which], t, verbatim, paraphrase).tolist():
            whole, near, so_far = items.words[item[which[k]]], word[lo[k] : hi[k]], best.get(int(of[k]))
            if so_far and so_far[1] == 1:
                continue
            coverage = common_subsequence(whole, near) / len(whole)
            if coverage < min(verbatim, paraphrase) or (so_far and coverage <= so_far[1]):
                continue
            answer = whole[-max(3, len(whole) // 5) :]
            found = common_subsequence(answer, near) / len(answer)
            if coverage >= verbatim or found >= ANSWER:
                best[int(of[k])] = (int(which[k]), coverage, found, int(place[lo[k]]))
        yield from best.values()


def _may_hold(word: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, t: Times, verbatim: float, paraphrase: float) -> np.ndarray:
    """Surroundings word[lo : hi] that hold enough words of the item, in whatever order."""
    out = []
    for one, two in tx.slices(np.r_[0, np.cumsum(hi - lo)], PLACES):
        n = (hi - lo)[one:two]
        pairs, times = np.unique((np.repeat(np.arange(one, two), n) << 32) | word[tx.ranges(lo[one:two], n)], return_counts=True)
        which = pairs >> 32
        at = np.searchsorted(t.key, (item[which] << 32) | (pairs & ((1 << 32) - 1)))
        coverage = np.bincount(which - one, np.minimum(times, t.times[at]), two - one) / t.size[item[one:two]]
        answer = np.bincount(which - one, np.minimum(times, t.in_answer[at]), two - one) / t.answer[item[one:two]]
        out.append(one + np.flatnonzero((coverage >= min(verbatim, paraphrase)) & ((coverage >= verbatim) | (answer >= ANSWER))))
    return np.concatenate([np.zeros(0, np.int64), *out])


_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass
class Sequences:
    """Items as sequences: those that are looked for at word w are items[first[w] : first[w + 1]]."""

    first: np.ndarray
    items: np.ndarray
    #: Of each item: where the word it is looked for at stands, its length, its hash.
    offset: np.ndarray
    length: np.ndarray
    hash: np.ndarray


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _spread(words: np.ndarray) -> np.ndarray:
    return tx.mix(words.astype(np.uint64) + np.uint64(1))


def sequences(items: Items, counts: np.ndarray) -> Sequences:
    """Each item is looked for at its word that the fewest documents have."""
    offset = np.array([int(np.argmin(counts[x])) for x in items.words], np.int64)
    anchor = np.array([x[o] for x, o in zip(items.words, offset, strict=True)], np.int64)
    power = _powers(max((len(x) for x in items.words), default=0))
    hashes = np.array([(_spread(x) * power[: len(x)]).sum(dtype=np.uint64) for x in items.words], np.uint64)
    order = np.argsort(anchor, kind="stable")
    first = np.searchsorted(anchor[order], np.arange(len(items.vocabulary) + 1))
    return Sequences(first, order, offset, np.array([len(x) for x in items.words], np.int64), hashes)


def copies(f: Found, s: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """(row of the first word, item) of all places that hold an item word for word."""
    n = s.first[f.word + 1] - s.first[f.word]
    item = s.items[tx.ranges(s.first[f.word], n)]
    start = np.repeat(np.arange(len(f.word)), n) - s.offset[item]
    inside = (start >= 0) & (start + s.length[item] <= len(f.word))
    item, start = item[inside], start[inside]
    end = start + s.length[item] - 1
    # Neighbouring words of one document have neighbouring places.
    close = (f.doc[start] == f.doc[end]) & (f.place[end] - f.place[start] == s.length[item] - 1)
    item, start, end = item[close], start[close], end[close]
    power = _powers(len(f.word) + 1)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(f.word) * power[:-1], dtype=np.uint64)])
    same = upto[end + 1] - upto[start] == s.hash[item] * power[start]
    return start[same], item[same]


def search(hits: DataFrame, items: Items, to: np.ndarray, counts: np.ndarray, idf: np.ndarray, space: np.ndarray, near: float, verbatim: float, paraphrase: float) -> DataFrame:
    pieces, exact, times = prepare(items, idf, space), sequences(items, counts), word_times(items)

    def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(items.words), len(items.vocabulary)), bool)
        for i, x in enumerate(items.words):
            held[i, x] = True
        for batch in _each_batch(batches):
            f = read_found(batch, to)
            if not len(f.word):
                continue
            best: dict[tuple[int, int], tuple] = {}
            for row, i in zip(*(x.tolist() for x in copies(f, exact)), strict=True):
                # Places come in order: the first copy is reported.
                best.setdefault((int(f.doc[row]), i), (1.0, 1.0, 1.0, int(f.place[row])))
            row, piece, cosine = near_windows(f, pieces, idf, near)
            doc, item, middle = f.doc[row], items.piece_item[piece], f.place[row] + pieces.size[piece] // 2
            order = np.lexsort((middle, item, doc))
            doc, item, middle, cosine = doc[order], item[order], middle[order], cosine[order]
            if best:
                left = ~np.isin(doc << 32 | item, [d << 32 | i for d, i in best])
                doc, item, middle, cosine = doc[left], item[left], middle[left], cosine[left]
            for k, *found in _compare_all(f, items, held, times, doc, item, middle, verbatim, paraphrase):
                best[int(doc[k]), int(item[k])] = (float(cosine[k]), *found)
            if best:
                docs, ids = [d for d, _ in best], [items.ids[i] for _, i in best]
                cosine_, coverage_, answer_, start_ = map(list, zip(*best.values(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(docs)), pa.array(ids, pa.int64()), pa.array(cosine_), pa.array(coverage_), pa.array(answer_), pa.array(start_, pa.int64())],
                    names=["doc_id", "item_id", "cosine", "coverage", "answer", "word_start"],
                )

    return hits.select("doc_id", "places", "words").mapInArrow(leaks, _LEAKS)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, near: float = NEAR, verbatim: float = 0.75, paraphrase: float = 0.5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each document and benchmark item (item_id, text) that leaked into it:
    doc_id, item_id, cosine, coverage, answer (share of its words found), word_start."""
    spark = docs.sparkSession
    work = Scratch(spark, "leaks")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    bench = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), F.lower("text").alias("text"))
    reads = max(1, -(-bench.count() // READ_ITEMS))
    documents = max(1, named.count())
    out: list[DataFrame] = []
    for r in range(reads):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(reads)) == r).collect()
        whole = read_items(sorted((x[0], x[1]) for x in rows))
        if not whole.ids:
            continue
        hits = work.save(find_words(named, whole.vocabulary), f"hits_{r}")
        counts = document_counts(hits, len(whole.vocabulary))
        # Fewer, larger tasks for the same rows.
        passages = hits.coalesce(max(FIT_TASKS, -(-total_bytes(hits) // FIT_BYTES)))
        for lo in range(0, len(whole.ids), ITEMS):
            items, to = some_items(whole, range(lo, min(lo + ITEMS, len(whole.ids))))
            mine = counts[to >= 0]
            idf = inverse_frequencies(mine, documents)
            space = latent_space(passages, items, to, idf)
            found = search(hits, items, to, mine, idf, space, near, verbatim, paraphrase)
            out.append(work.save(found, f"leaks_{r}_{lo}"))
        work.drop(f"hits_{r}")
    if not out:
        return spark.createDataFrame([], _LEAKS)
    together = out[0]
    for found in out[1:]:
        together = together.union(found)
    best = F.max(F.struct("coverage", "cosine", "answer", (-F.col("word_start")).alias("at"))).alias("b")
    return together.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.coverage", "b.answer", (-F.col("b.at")).alias("word_start"))
