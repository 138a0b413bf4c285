"""Language identification by rank-order profiles of character n-grams.

Texts are lower-cased and cut into words of letters; a word is padded with one blank
on each side and gives its 1- to 3-grams. A profile lists the ``PROFILE`` most
frequent n-grams by rank (ties by n-gram). A document goes to the language whose
profile is nearest by out-of-place distance: the sum, over the document's own most
frequent n-grams, of how many places each is off, or ``PROFILE`` where the language
lacks it. Equal distances go to the first language by name.

Characters count in 4096 classes: those below U+0800 each have their own, others
share by remainder. Texts without letters, empty or null, are ``und`` with score 0.
Without learned languages every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tidemark.llm import text as tx

PROFILE = 300
UNKNOWN = "und"
BLANK = 1
_CLASS_BITS = 12
_GRAM_BITS = 3 * _CLASS_BITS
_SLICE = 1 << 20


def _letter_classes() -> np.ndarray:
    """The class of each character of the basic plane: 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint16)
    for code in range(1 << 16):
        if not 0xD800 <= code < 0xE000 and chr(code).isalpha():
            out[code] = code if code < 2048 else 2048 + code % 2048
    return out


_CLASSES: list[np.ndarray] = []


def classes(codes: np.ndarray) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(_letter_classes())
    out = _CLASSES[0][np.minimum(codes, 0xFFFF)]
    beyond = np.flatnonzero(codes > 0xFFFF)
    for i in beyond:
        out[i] = 2048 + codes[i] % 2048 if chr(codes[i]).isalpha() else 0
    return out


def grams(texts: list[str], group: np.ndarray) -> np.ndarray:
    """Keys ``group << 36 | n-gram`` of all n-grams of lower-cased texts, unordered."""
    joined = " " + " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(group, [len(t) + 1 for t in texts])
    owner = np.r_[owner[:1], owner] if len(owner) else np.zeros(len(codes), np.int64)
    kind = classes(codes)
    kept = kind > 0
    edge = ~kept
    edge[1:-1] &= kept[:-2] | kept[2:]
    # One blank may end a word and begin the next; n-grams across it are left out below.
    at = np.flatnonzero(kept | edge)
    a = np.where(kept[at], kind[at], BLANK).astype(np.uint64)
    own = owner[at].astype(np.uint64) << np.uint64(_GRAM_BITS)
    if len(a) < 3:
        return np.zeros(0, np.uint64)
    b = np.uint64(_CLASS_BITS)
    letter = a != BLANK
    near = np.diff(at) == 1
    two = (a[:-1] << b) | a[1:]
    three = (two[:-1] << b) | a[2:]
    # An n-gram belongs to the text of a letter in it.
    own2 = np.where(letter[:-1], own[:-1], own[1:])
    ok2 = near & (letter[:-1] | letter[1:])
    ok3 = near[:-1] & near[1:] & letter[1:-1]
    return np.concatenate([(own | a)[letter], (own2 | two)[ok2], (own[1:-1] | three)[ok3]])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.diff(np.r_[new, len(keys)])


@dataclass
class Profiles:
    """Ranks of n-grams in each language: ``ranks[i, j]`` is of ``grams[i]`` in ``names[j]``."""

    names: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def learn_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> Profiles:
    """Profiles from all rows with a text and a language: ``size`` n-grams for each language
    come to the driver."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.lower(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tx.release()
            named = batch.column(0).dictionary_encode()
            group = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, off = tx.bytes_of(batch.column(1))
            parts = []
            for lo, hi in tx.slices(off, _SLICE):
                parts.append(counted(grams(batch.column(1).slice(lo, hi - lo).to_pylist(), group[lo:hi])))
            keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            if not len(keys):
                continue
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            total, keys = np.add.reduceat(n, new), keys[new]
            lang_of = named.dictionary.take(pa.array((keys >> np.uint64(_GRAM_BITS)).astype(np.int64)))
            gram = (keys & np.uint64((1 << _GRAM_BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([lang_of.cast(pa.string()), pa.array(gram), pa.array(total)], names=["lang", "gram", "n"])

    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < size).collect()
    names = sorted({r["lang"] for r in top})
    all_grams = np.array(sorted({r["gram"] for r in top}), np.uint64)
    ranks = np.full((len(all_grams), len(names)), -1, np.int32)
    place = {g: i for i, g in enumerate(all_grams.tolist())}
    column = {x: j for j, x in enumerate(names)}
    for r in top:
        ranks[place[r["gram"]], column[r["lang"]]] = r["rank"]
    return Profiles(names, all_grams, ranks)


def distances(texts: list[str], profiles: Profiles, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distances (texts by languages) and the number of n-grams ranked."""
    n = len(texts)
    keys, times = counted(grams(texts, np.arange(n)))
    doc = (keys >> np.uint64(_GRAM_BITS)).astype(np.int64)
    # By document, then most frequent first, then by n-gram: the key's place is its n-gram's order.
    fewer = (np.int64(1) << 24) - 1 - np.minimum(times, (1 << 24) - 1)
    if len(keys) >= 1 << 22 or n >= 1 << 17:
        order = np.lexsort((keys, fewer, doc))
    else:
        packed = (doc.astype(np.uint64) << np.uint64(46)) | (fewer.astype(np.uint64) << np.uint64(22)) | np.arange(len(keys), dtype=np.uint64)
        order = (np.sort(packed) & np.uint64((1 << 22) - 1)).astype(np.int64)
    first = np.searchsorted(doc, np.arange(n + 1))
    rank = np.arange(len(keys)) - np.repeat(first[:-1], np.diff(first))
    top = rank < size
    gram, own, rank = (keys[order] & np.uint64((1 << _GRAM_BITS) - 1))[top], doc[top], rank[top]
    used = np.bincount(own, minlength=n)
    out = np.zeros((n, len(profiles.names)), np.int64)
    if not len(gram) or not len(profiles.names):
        return out, used
    at = np.minimum(np.searchsorted(profiles.grams, gram), len(profiles.grams) - 1)
    known = profiles.grams[at] == gram
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    for j in range(len(profiles.names)):
        theirs = np.where(known, profiles.ranks[at, j], -1)
        off = np.where(theirs < 0, size, np.abs(theirs - rank))
        out[own[begin], j] = np.add.reduceat(off, begin)
    return out, used


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score (1 less the distance over its largest value), in
    place of columns of these names; the text is not changed."""
    base = docs.drop("lang_pred", "score")
    names = base.columns
    # The text goes through the task once, and is lower-cased there.
    place = names.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tx.release()
            column = batch.column(place)
            _, off = tx.bytes_of(column)
            for lo, hi in tx.slices(off, _SLICE):
                for a in range(lo, hi, 1 << 16):
                    b = min(hi, a + (1 << 16))
                    found, used = distances([(x or "").lower() for x in column.slice(a, b - a).to_pylist()], profiles, size)
                    if profiles.names:
                        best = found.argmin(axis=1)
                        score = np.where(used > 0, 1 - found[np.arange(b - a), best] / np.maximum(used * size, 1), 0.0)
                        label = [profiles.names[j] if u else UNKNOWN for j, u in zip(best.tolist(), used.tolist(), strict=True)]
                    else:
                        score, label = np.zeros(b - a), [UNKNOWN] * (b - a)
                    kept = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1))], names=schema.names)

    return base.mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
