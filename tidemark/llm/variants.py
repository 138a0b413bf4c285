"""Spelling variants: words one edit apart, found through a reduced alphabet.

Words come from all documents: runs of letters in lower case, some with one letter left
out (by a hash of document and run), counted over the corpus. Each letter is hashed to one of
``SYMBOLS`` symbols, so that a word has a reduced word. Two words one edit apart have
reduced words at most one edit apart: every word generates the whole one-edit
neighbourhood of its reduced word (itself, and every deletion, replacement and insertion),
over few symbols, whatever the size of the alphabet. Neighbourhoods are joined with the
vocabulary's reduced words, and the original words of a match are verified.

An edit leaves the letters on one side of it as they are. A generated string carries the half
of the original word that its edit does not touch, and a reduced word is offered once with
its first half and once with its second. So words that merely share a reduced word, however
many, don't meet: candidates grow with real look-alikes.

Of its near words, a word's form is the one that occurs most, if it occurs at least ``RATIO``
times as often as the word; forms occur ever more often, so that following them ends, in
rounds that each double the way.

Cases: null texts have no words; a null id counts as the empty string in the hash; rows that
repeat are counted again. Runs of any length are words; a run of L letters generates about
2 * ``SYMBOLS`` * L strings of its length, so runs of over ``LONG`` letters are joined by
the hashes of their deletions instead, which are L strings of 8 bytes, and verified alike.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import Scratch

LETTERS = r"([A-Za-zÀ-ÿ]+)"
SYMBOLS, RATIO, LONG = 4, 2, 64
LEAST_LETTERS, LEAST_TIMES, ONE_IN = 5, 3, 97
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str, text: str, least_letters: int, least_times: int, one_in: int) -> DataFrame:
    """(word, n) of all documents."""
    lower = F.translate(F.col(text), _UPPER, _LOWER)
    runs = docs.select(F.col(doc_id).cast("string").alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(1))).alias("run"))
    # Leaving out a letter never makes a run longer.
    runs = runs.where(F.length("run") >= least_letters)
    h = F.crc32(F.encode(F.concat_ws(":", F.coalesce("id", F.lit("")), "run"), "UTF-8"))
    at = (h % F.length("run") + 1).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at - 1), F.substring("run", at + 1, F.length("run")))
    word = F.when(h % one_in == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def reduce_letters(word: str, symbols: int) -> bytes:
    """The reduced word: a symbol for each letter."""
    # The multiplier spreads neighbouring code points over the symbols.
    return bytes(97 + ((ord(c) * 2654435761 >> 16) % symbols) for c in word)


def _key(reduced: bytes, side: bytes, half: str) -> int:
    """A 64-bit key of a reduced word with one half of the original."""
    return xxhash.xxh3_64_intdigest(reduced + side + half.encode()) - (1 << 63)


def offered(word: str, symbols: int) -> tuple[int, int]:
    """The keys under which a word can be met: with its first half and with its second."""
    r, h = reduce_letters(word, symbols), len(word) // 2
    return _key(r, b"<", word[:h]), _key(r, b">", word[h:])


def generated(word: str, symbols: int) -> set[int]:
    """The keys of the reduced word's one-edit neighbourhood, each with the half that the
    edit leaves."""
    r, n = reduce_letters(word, symbols), len(word)
    alphabet = [bytes([97 + s]) for s in range(symbols)]
    out: set[int] = set()

    def add(near: bytes, at: int, size: int, skip: int) -> None:
        # An edit before letter ``at`` of the new word (of ``size``), whose letters from
        # ``skip`` on are the old word's last ones.
        h = size // 2
        if at >= h:
            out.add(_key(near, b"<", word[:h]))
        if skip <= h:
            out.add(_key(near, b">", word[n - (size - h) :]))

    for i in range(n):
        add(r[:i] + r[i + 1 :], i, n - 1, i)
        for s in alphabet:
            # The letter's own symbol is among them: another letter can share it.
            add(r[:i] + s + r[i + 1 :], i, n, i + 1)
    for i in range(n + 1):
        for s in alphabet:
            add(r[:i] + s + r[i:], i, n + 1, i + 1)
    return out


def _deletions(word: str) -> set[int]:
    return {xxhash.xxh3_64_intdigest((word[:i] + word[i + 1 :]).encode()) - (1 << 63) for i in range(len(word))}


def _keys(words: DataFrame, symbols: int, long: int, generate: bool) -> DataFrame:
    """(key, word, and what comes with it): keys that words generate, or are offered by."""

    def keys(word: str) -> set[int]:
        # Long words meet by what is left when one letter goes: their own text counts too.
        # Words around the bound take part in both ways.
        out = set(generated(word, symbols) if generate else offered(word, symbols)) if len(word) <= long + 1 else set()
        if len(word) > long - 1:
            out |= _deletions(word) | {xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)}
        return out

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [list(keys(w)) for w in part.column(0).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                key = pa.array([k for x in found for k in x], pa.int64())
                columns = [key, *(c.take(of) for c in part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", *part.schema.names])

    return words.mapInArrow(make, T.StructType([T.StructField("key", T.LongType()), *words.schema.fields]))


def near_words(words: DataFrame, symbols: int = SYMBOLS, long: int = LONG) -> DataFrame:
    """(word, other, other_n): every ordered pair of words exactly one edit apart, once."""
    made = _keys(words.select("word"), symbols, long, True)
    there = _keys(words.select("word", "n"), symbols, long, False).withColumnsRenamed({"word": "other", "n": "other_n"})
    alike = (F.col("word") != F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1)
    met = made.join(there, "key").where(alike & (F.levenshtein("word", "other", 1) == 1))
    # Words can meet by both halves, or in both ways.
    return met.groupBy("word", "other").agg(F.first("other_n").alias("other_n"))


def _follow(linked: DataFrame, work: Scratch) -> DataFrame:
    """(word, form) with null for no form, to (word, root). Each round doubles the way."""
    now = work.save(linked.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNull().alias("ends")), "way_0")
    step = 0
    while not now.where("NOT ends").isEmpty():
        step += 1
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"), F.col("ends").alias("there"))
        open_ = now.where("NOT ends").join(onward, "root").select("word", F.col("further").alias("root"), F.col("there").alias("ends"))
        now = work.save(now.where("ends").unionByName(open_), f"way_{step}")
        work.drop(f"way_{step - 1}")
    return now.select("word", "root")


def group_variants(
    docs: DataFrame,
    least_letters: int = LEAST_LETTERS,
    least_times: int = LEAST_TIMES,
    one_in: int = ONE_IN,
    ratio: int = RATIO,
    symbols: int = SYMBOLS,
    long: int = LONG,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each word: word, n, n_near, form, form_n, root."""
    work = Scratch(docs.sparkSession, "variants")
    words = work.save(word_counts(docs, doc_id, text, least_letters, least_times, one_in), "words")
    near = near_words(words, symbols, long)
    # Strings compare by code point: of the most frequent, the least word.
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word"))).alias("best")
    met = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    seen = words.join(met, "word", "left")
    has: Column = -F.col("best.minus") >= ratio * F.col("n")
    told = work.save(
        seen.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has, F.col("best.word")).alias("form"),
            F.when(has, -F.col("best.minus")).alias("form_n"),
        ),
        "told",
    )
    work.drop("words")
    return told.join(_follow(told, work), "word")
