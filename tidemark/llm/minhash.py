"""Near duplicates by min-max hashing: exact links and their components.

A document is the set of its word shingles. Under each permutation of the shingles
both the least and the greatest value are kept, so one evaluation gives two signature
values. Values are cut into bands; documents that agree on a band are compared on
their full sets, so a link is never an estimate. The number of bands follows from the
similarity asked for: a pair at exactly that similarity is missed with a probability
of at most ``MISS``.

No pairs of a group are listed. Documents with the same set are one class, which its
least id stands for. Inside a bucket every document is first compared with one earlier
look-alike; whatever already hangs together needs no further comparison, and only
buckets that still hold several components are compared in full, with sets as rows of
bits. Buckets over ``BUCKET`` documents are cut into pairs of chunks that any task can
take.

Null or empty texts, and texts without words, have an empty set and link with nothing;
with fewer words than a shingle, the whole sequence is the one shingle. Rows with a null
id link with nothing. Rows of the same id share a component and are all returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.components import connected_components
from tidemark.llm.scratch import Scratch

MISS = 1e-6
#: Documents of a bucket compared in one go.
BUCKET = 4096
#: Estimates this many standard deviations below the wanted similarity are not followed up.
DEVIATIONS = 6.0
_BLOCK = 1 << 15


def bands_for(similarity: float) -> tuple[int, int]:
    """(rows, bands): as many rows in a band as 40 bands allow, an even number of bands."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log(1 - similarity**rows))
        if bands <= 40:
            return rows, bands + bands % 2
    return 1, 40


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered in each text, and the offsets of the texts."""
    w = tx.words(data, off)
    h = tx.word_hashes(data, w)
    grams = tx.window_hashes(h, k)
    count = np.diff(w.first)
    out = []
    for a, n in zip(w.first[:-1].tolist(), count.tolist(), strict=True):
        if n >= k:
            found = np.sort(grams[a : a + n - k + 1])
            out.append(found[np.r_[True, found[1:] != found[:-1]]])
        elif n:
            out.append(tx.mix(tx.window_hashes(h[a : a + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    bounds = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), bounds


def signatures(items: np.ndarray, bounds: np.ndarray, permutations: int, seed: int = 1) -> np.ndarray:
    """(texts, 2 * permutations): the least values, then the greatest. Empty sets give 0."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 1 << 62, permutations).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 62, permutations).astype(np.uint64)
    out = np.zeros((len(bounds) - 1, 2 * permutations), np.uint64)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    if not len(filled):
        return out
    starts = bounds[filled]
    lo = 0
    while lo < len(filled):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _BLOCK)))
        end = bounds[filled[hi - 1] + 1]
        part, cut, rows = items[starts[lo] : end], starts[lo:hi] - starts[lo], filled[lo:hi]
        for j in range(permutations):
            # Multiplying by an odd number after a shift by xor permutes all 64-bit numbers;
            # their order is that of the high bits.
            v = (part ^ shifts[j]) * factors[j]
            out[rows, j] = np.minimum.reduceat(v, cut)
            out[rows, permutations + j] = np.maximum.reduceat(v, cut)
        lo = hi
    return out


def _profile(data: np.ndarray, off: np.ndarray, k: int, rows: int, bands: int) -> dict[str, list | np.ndarray]:
    items, bounds = shingles(tx.lower_ascii(data), off, k)
    sizes = np.diff(bounds)
    sign = signatures(items, bounds, rows * bands // 2)
    check = np.zeros(len(items) + 1, np.uint64)
    sums = []
    for salt in (1, 2):
        np.cumsum(tx.mix(items + np.uint64(salt)), out=check[1:])
        sums.append((check[bounds[1:]] - check[bounds[:-1]]).view(np.int64))
    grouped = sign.reshape(len(sizes), bands, rows)
    keys = np.zeros((len(sizes), bands), np.uint64)
    for r in range(rows):
        keys = tx.mix(keys * np.uint64(3) + grouped[:, :, r])
    keys = tx.mix(keys + np.arange(bands, dtype=np.uint64))
    short = (tx.mix(sign) >> np.uint64(56)).astype(np.uint8)
    return {"n": sizes, "h1": sums[0], "h2": sums[1], "keys": keys.view(np.int64), "sign": short}


def profiles(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, text) to (doc_id, n, h1, h2, keys, sign): the size and two sums of a set, its
    bands' hashes and a byte of each signature value."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.bytes_of(batch.column(1))
            for lo, hi in tx.slices(off, 1 << 20):
                p = _profile(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k, rows, bands)
                n = hi - lo
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(p["keys"].ravel()))
                sign = pa.array([x.tobytes() for x in p["sign"]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(p["n"]), pa.array(p["h1"]), pa.array(p["h2"]), keys, sign],
                    names=["doc_id", "n", "h1", "h2", "keys", "sign"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(made, "doc_id long, n long, h1 long, h2 long, keys array<long>, sign binary")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text) to (doc_id, items): ordered 64-bit shingle hashes as bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.bytes_of(batch.column(1))
            for lo, hi in tx.slices(off):
                items, bounds = shingles(tx.lower_ascii(data[off[lo] : off[hi]]), off[lo : hi + 1] - off[lo], k)
                sets = [items[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc_id", "items"])

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id long, items binary")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows equal in the first ``width`` columns, from ordered batches."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        new = np.zeros(n, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(new).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(c[a] for c in cols)
            if key is not None and here != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _in_chunks(buckets: DataFrame, order: str) -> DataFrame:
    """Buckets (key, ...) over ``BUCKET`` rows become pairs of chunks (i, j); others (0, 0).
    A row of a cut bucket goes to every pair with its chunk."""
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > BUCKET)
    sizes = sizes.select(F.col("key").alias("_key"), F.ceil(F.col("_size") / (BUCKET // 2)).cast("int").alias("_parts"))
    cut = buckets.join(sizes, F.col("key") == F.col("_key"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    mine = F.pmod(F.xxhash64(order), F.col("_parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda other: F.struct(F.least(other, F.col("_mine")).alias("i"), F.greatest(other, F.col("_mine")).alias("j")),
    )
    return cut.withColumn("_mine", mine).withColumn("_pair", F.explode(pairs)).drop("_key", "_parts").select(
        "key", F.col("_pair.i").alias("i"), F.col("_pair.j").alias("j"), *(c for c in buckets.columns if c != "key")
    )


def look_alikes(buckets: DataFrame, similarity: float, values: int) -> DataFrame:
    """(key, doc_id, sign) to (key, doc_id, mate): documents of a bucket whose signature looks
    similar enough to another's, with the first such."""
    spread = math.sqrt(similarity * (1 - similarity) / values)
    most = math.floor(values * (1 - similarity + DEVIATIONS * spread))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            doc = group.column(3).to_numpy()
            sign = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint8).reshape(len(doc), values)
            order = np.argsort(doc, kind="stable")
            doc, sign = doc[order], sign[order]
            mate = np.full(len(doc), -1, np.int64)
            step = max(1, (1 << 22) // (len(doc) * values))
            for a in range(0, len(doc), step):
                todo = slice(a, a + step)
                like = (sign[todo, None, :] != sign[None, :, :]).sum(axis=2, dtype=np.int32) <= most
                like[np.arange(like.shape[0]), np.arange(a, a + like.shape[0])] = False
                mate[todo] = np.where(like.any(axis=1), like.argmax(axis=1), -1)
            got = np.flatnonzero(mate >= 0)
            out += zip([key[0]] * len(got), doc[got].tolist(), doc[mate[got]].tolist(), strict=True)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "doc_id", "mate"), x, strict=True)) for x in out])
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "doc_id", "mate"), x, strict=True)) for x in out])

    dealt = _in_chunks(buckets, "doc_id").select("key", "i", "j", "doc_id", "sign")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(found, "key long, doc_id long, mate long")


def _similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, ok = batch.column(2), batch.column(3), []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(bool(len(x) and _similar(common, len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    one = sets.select(F.col("doc_id").alias("_a"), F.col("items").alias("x"))
    two = sets.select(F.col("doc_id").alias("_b"), F.col("items").alias("y"))
    full = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    return full.select("a", "b", "x", "y").mapInArrow(kept, "a long, b long")


def _bit_rows(sets: list[np.ndarray]) -> np.ndarray:
    """Each set as bits over the items that at least two sets have."""
    joined = np.concatenate(sets)
    ordered = np.sort(joined)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    words = max(1, -(-len(shared) // 64))
    rows = np.zeros((len(sets), words * 64), bool)
    for i, s in enumerate(sets):
        if len(shared):
            at = np.minimum(np.searchsorted(shared, s), len(shared) - 1)
            rows[i, at[shared[at] == s]] = True
    return np.packbits(rows, axis=1).view(np.uint64)


def link_components(buckets: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id, component, items) to (a, b) links between different components: enough
    of them to join all components of a bucket that any link joins."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, 3):
            doc, comp = group.column(3).to_numpy(), group.column(4).to_numpy()
            if len(doc) < 2 or len(np.unique(comp)) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in group.column(5).to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            bits = _bit_rows(sets)
            comp = comp.copy()
            a_out, b_out = [], []
            # Members of the largest component are compared only with the others.
            names, times = np.unique(comp, return_counts=True)
            todo = np.flatnonzero(comp != names[times.argmax()])
            for i in todo.tolist():
                other = np.flatnonzero(comp != comp[i])
                step = max(1, (1 << 20) // bits.shape[1])
                for c in range(0, len(other), step):
                    at = other[c : c + step]
                    common = np.bitwise_count(bits[at] & bits[i]).sum(axis=1, dtype=np.int64)
                    for j in at[_similar(common, size[at], size[i], percent)].tolist():
                        if comp[j] != comp[i]:
                            a_out.append(doc[i])
                            b_out.append(doc[j])
                            comp[comp == comp[j]] = comp[i]
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    dealt = _in_chunks(buckets, "doc_id").select("key", "i", "j", "doc_id", "component", "items")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the least id reachable
    over links) and kept (doc_id = component_id).

    Documents are linked when 100 * intersection >= percent * union.
    """
    similarity = percent / 100
    rows, bands = bands_for(similarity)
    work = Scratch(docs.sparkSession, "minhash")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = work.save(profiles(named, k, rows, bands), "profiles")

    # One document stands for all with the same set.
    filled = known.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = filled.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = work.save(classes, "classes")
    reps = classes.select(F.col("rep").alias("_rep"))
    lead = filled.join(reps, F.col("doc_id") == F.col("_rep"), "left_semi").dropDuplicates(["doc_id"])
    buckets = lead.select(F.explode("keys").alias("key"), "doc_id")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(F.col("key").alias("_key"))
    members = work.save(buckets.join(shared, F.col("key") == F.col("_key"), "left_semi"), "members")
    signed = members.join(lead.select(F.col("doc_id").alias("_id"), "sign"), F.col("doc_id") == F.col("_id")).select("key", "doc_id", "sign")
    alike = work.save(look_alikes(signed, similarity, rows * bands), "alike")

    wanted = alike.select(F.col("doc_id").alias("_id")).distinct()
    texts = named.join(wanted, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id"])
    sets = work.save(shingle_sets(texts, k), "sets")
    pairs = alike.select(F.least("doc_id", "mate").alias("a"), F.greatest("doc_id", "mate").alias("b")).distinct()
    links = work.save(verify(pairs, sets, percent), "links")
    found = connected_components(links, work, "first")

    # Buckets of three and more whose members do not hang together yet.
    part = found.select(F.col("node").alias("_node"), "component")
    placed = alike.select("key", "doc_id").distinct().join(part, F.col("doc_id") == F.col("_node"), "left")
    placed = placed.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    mixed = mixed.where((F.col("_n") > 2) & (F.col("_lo") != F.col("_hi"))).select(F.col("key").alias("_key"))
    placed = placed.join(mixed, F.col("key") == F.col("_key"), "left_semi")
    items = sets.select(F.col("doc_id").alias("_id"), "items")
    more = work.save(link_components(placed.join(items, F.col("doc_id") == F.col("_id")).drop("_id"), percent), "more")
    if more.limit(1).count():
        found = connected_components(links.union(more), work, "second")

    part = found.select(F.col("node").alias("_node"), "component")
    named_classes = classes.join(part, F.col("rep") == F.col("_node"), "left").select(
        F.col("n").alias("_cn"), F.col("h1").alias("_c1"), F.col("h2").alias("_c2"), F.coalesce("component", "rep").alias("component_id")
    )
    same = (F.col("n") == F.col("_cn")) & (F.col("h1") == F.col("_c1")) & (F.col("h2") == F.col("_c2"))
    work.drop("members", "alike", "sets", "links", "more")
    out = known.select("doc_id", "n", "h1", "h2").join(named_classes, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
