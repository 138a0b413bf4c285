"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie over bytes. Every node has a failure link, to the node for
what is left of its string once the pieces that greedy matching would take from it are
popped, and the number of these pieces; so a word's count is a sum along one walk, and
no piece is ever built. All words of a batch walk at once, a byte at a time.

A word is written with ``WORD_START`` in front, as the vocabulary does. Every byte is a
piece too, so any text has a count. Null and empty texts have no words and no tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import text as tx

#: Fixed value: the mark that sentence-piece vocabularies put before a word.
WORD_START = "▁"
#: Words with more bytes walk on their own.
LONG = 512


_EMPTY = np.int64(-1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Automaton:
    """Transitions in an open hash table: ``keys`` holds node * 256 + byte, ``to`` the next node."""

    keys: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    #: Pieces in all that are popped when the text ends at a node.
    flushed: np.ndarray
    start: int
    _plain: tuple | None = None

    def plain(self) -> tuple[dict, list, list]:
        """Transitions, failure links and popped counts as Python objects, made once."""
        if self._plain is None:
            self._plain = (dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), self.fail.tolist(), self.popped.tolist())
        return self._plain

    def go(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node for each node and byte, -1 where there is none."""
        key = (node.astype(np.int64) << 8) | byte
        slot = _slots(key, len(self.keys))
        found = self.keys[slot]
        out = np.where(found == key, self.to[slot], -1)
        open_ = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


def read_pieces(path: str) -> list[bytes]:
    """The ordinary pieces of a sentence-piece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [model.id_to_piece(i).encode() for i in ids]


def build(pieces: Iterable[bytes], prefix: bytes = WORD_START.encode()) -> Automaton:
    """The automaton of a vocabulary; ``prefix`` is put before every word."""
    children: list[dict[int, int]] = [{}]
    ends = [False]
    for piece in {*pieces, *(bytes([c]) for c in range(256))} - {b""}:
        v = 0
        for c in piece:
            if c not in children[v]:
                children[v][c] = len(children)
                children.append({})
                ends.append(False)
            v = children[v][c]
        ends[v] = True

    # Failure links, breadth first: a node's string is its parent's and one more byte.
    n = len(children)
    fail, popped, flushed = [0] * n, [0] * n, [0] * n
    order = [0]
    for u in order:
        for c, v in children[u].items():
            order.append(v)
            if ends[v]:
                fail[v], popped[v] = 0, 1
            else:
                z, count = fail[u], popped[u]
                while c not in children[z]:
                    count += popped[z]
                    z = fail[z]
                fail[v], popped[v] = children[z][c], count
    for v in sorted(range(1, n), key=_depths(children).__getitem__):
        flushed[v] = popped[v] + flushed[fail[v]]

    keys, to = _hashed(children)
    start = 0
    for c in prefix:
        if c not in children[start]:
            raise ValueError("no piece begins with the word mark")
        start = children[start][c]
    as32 = lambda x: np.array(x, np.int32)
    return Automaton(keys, to, as32(fail), as32(popped), as32(flushed), start)


def _depths(children: list[dict[int, int]]) -> list[int]:
    depth, order = [0] * len(children), [0]
    for u in order:
        for v in children[u].values():
            depth[v] = depth[u] + 1
            order.append(v)
    return depth


def _hashed(children: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << (8 * len(children)).bit_length()
    keys, to = np.full(size, _EMPTY), np.zeros(size, np.int32)
    edges = [(u << 8 | c, v) for u, row in enumerate(children) for c, v in row.items()]
    for slot, (key, v) in zip(_slots(np.array([e[0] for e in edges]), size).tolist(), edges, strict=True):
        while keys[slot] != _EMPTY:
            slot = (slot + 1) % size
        keys[slot], to[slot] = key, v
    return keys, to


def count_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: Automaton) -> np.ndarray:
    """The number of pieces of each word."""
    length = end - start
    out = np.zeros(len(start), np.int64)
    order = np.argsort(-np.minimum(length, LONG + 1).astype(np.int16), kind="stable")
    long = int(np.searchsorted(-length[order], -LONG, "left"))
    for i in order[:long].tolist():
        out[i] = _count_one(data[start[i] : end[i]].tobytes(), a)
    order = order[long:]
    if not len(order):
        return out
    at, left = start[order], length[order]
    node = np.full(len(order), a.start, np.int32)
    total = np.zeros(len(order), np.int32)
    for step in range(int(left[0])):
        active = int(np.searchsorted(-left, -step, "left"))
        c = data[at[:active] + step].astype(np.int32)
        here = node[:active]
        after = a.go(here, c)
        bad = np.flatnonzero(after < 0)
        while len(bad):
            v = here[bad]
            total[bad] += a.popped[v]
            here[bad] = a.fail[v]
            after[bad] = a.go(here[bad], c[bad])
            bad = bad[after[bad] < 0]
        node[:active] = after
    out[order] = total + a.flushed[node]
    return out


def _count_one(word: bytes, a: Automaton) -> int:
    """The same for one long word."""
    moves, fail, popped = a.plain()
    v, count = a.start, 0
    for c in word:
        while (v << 8 | c) not in moves:
            count += popped[v]
            v = fail[v]
        v = moves[v << 8 | c]
    return count + int(a.flushed[v])


def count_tokens(docs: DataFrame, pieces: list[bytes], text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by n_bytes, n_words and n_tokens. The automaton, some
    hundred bytes for each byte of the vocabulary, goes to every executor once."""
    added = ("n_bytes", "n_words", "n_tokens")
    rest = docs.drop(text, *added)
    names = rest.columns
    schema = T.StructType([*rest.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    shared = docs.sparkSession.sparkContext.broadcast(build(pieces))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.bytes_of(batch.column(len(names)))
            for lo, hi in tx.slices(off, 1 << 20):
                raw, bounds = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                w = tx.words(raw, bounds)
                each = np.zeros(len(w) + 1, np.int64)
                np.cumsum(count_pieces(raw, w.start, w.end, shared.value), out=each[1:])
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(names))]
                found = (np.diff(bounds), np.diff(w.first), each[w.first[1:]] - each[w.first[:-1]])
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=schema.names)

    return docs.select(*names, text).mapInArrow(counted, schema)
