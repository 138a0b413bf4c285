"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are a lexicon (words) and patterns (beginnings of words, four to eight
characters long), occurring once or several times, that documents marked toxic hold far more often than others; their
counts come from the labelled training documents. Whether a voter fires is evidence, not
truth: a label model with one hidden label per document estimates, by expectation
maximisation over the votes alone, how often each voter fires in either class. Voters
are not independent (a pattern fires with every word it begins); the model estimates
their correlations inside the classes and shares the weight of voters that say the same.
Its posteriors are the labels of a logistic regression over the same votes, which scores
every document.

Scores cover all rows and whole texts. The fit uses whole texts of at most ``FIT_ROWS``
labelled documents, chosen by a hash of their ids.

Null and empty texts have no votes and get the score of that. Without training rows, or
without toxic ones, the score is the share of toxic rows (0 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import text as tx
from tidemark.llm.scratch import Scratch

#: Labelled documents that voters, label model and regression are fitted on, at most; their
#: ids and marks go to all tasks (nine bytes each).
FIT_ROWS = 100_000
#: Voters, at most: those with the strongest evidence (a likelihood ratio).
VOTERS = 3000
#: Toxic documents a voter needs, its least share among toxic over that among other
#: documents, and its least evidence.
SUPPORT, LIFT, EVIDENCE = 4, 8.0, 15.0
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is a voter of its own at each of these numbers of occurrences in a document.
LEVELS = (1, 2, 4)
#: Bits of a feature's hash; with a text's number in a slice they fill a word.
FEATURE_BITS = 50
#: Documents with a vote are toxic with this probability when the label model starts.
FIRST_GUESS = 0.9
#: How many imagined documents hold each voter's rates to the counted ones.
PRIOR_ROWS = 20.0
RIDGE = 1.0
#: Correlations inside the toxic class from which voters share their weight.
STRONG = 0.5

_LETTERS = np.full(256, 0x20, np.uint8)
for _c in (39, *range(65, 91), *range(97, 123), *range(128, 256)):
    _LETTERS[_c] = _c


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and every beginning of a longer word, of lower-cased texts."""
    plain = _LETTERS[data]
    w = tx.words(plain, off)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = w.text_of()
    heads = np.flatnonzero((plain & 0xC0) != 0x80)  # where characters begin
    first = np.searchsorted(heads, w.start)
    chars = np.searchsorted(heads, w.end) - first
    docs, hashes = [doc], [tx.word_hashes(plain, w)]
    for n in PREFIXES:
        long = np.flatnonzero(chars > n)
        begin = w.start[long]
        part = tx.Words(begin, heads[first[long] + n], w.first)
        docs.append(doc[long])
        hashes.append(tx.mix(tx.word_hashes(plain, part) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes) >> np.uint64(64 - FEATURE_BITS)


def _counted(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) in order, and how often each occurs."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(FEATURE_BITS)) | feature)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), key & np.uint64((1 << FEATURE_BITS) - 1), times


def _slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of few enough texts for ``_counted``."""
    for lo, hi in tx.slices(off, 1 << 20):
        for a in range(lo, hi, 1 << (64 - FEATURE_BITS)):
            yield a, min(hi, a + (1 << (64 - FEATURE_BITS)))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(text, toxic) rows to (feature, level, toxic_docs, other_docs): how many documents hold a
    feature at least ``level`` times."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.bytes_of(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            found = []
            for lo, hi in _slices(off):
                doc, feature, times = _counted(*features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                for i, level in enumerate(LEVELS):
                    enough = times >= level
                    # The feature, its level and the label in one number.
                    found.append(feature[enough] << np.uint64(3) | np.uint64(i << 1) | toxic[lo + doc[enough]].astype(np.uint64))
            keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *found]))
            if not len(keys):
                continue
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            times, keys = np.diff(np.r_[new, len(keys)]), keys[new]
            bad = (keys & np.uint64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((keys >> np.uint64(3)).astype(np.int64)),
                    pa.array(np.array(LEVELS, np.int32)[(keys >> np.uint64(1) & np.uint64(3)).astype(np.int64)]),
                    pa.array(times * bad),
                    pa.array(times * (1 - bad)),
                ],
                names=["feature", "level", "toxic_docs", "other_docs"],
            )

    each = rows.select("text", F.col("toxic").cast("int")).mapInArrow(counted, "feature long, level int, toxic_docs long, other_docs long")
    return each.groupBy("feature", "level").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("other_docs").alias("other_docs"))


@dataclass
class Voters:
    """Voter ``table[i, j]`` fires where feature ``base[i]`` occurs ``LEVELS[j]`` times or more."""

    base: np.ndarray
    table: np.ndarray
    count: int


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float


def choose_voters(counts: DataFrame, toxic: int, other: int, most: int = VOTERS) -> tuple[Voters, np.ndarray, np.ndarray]:
    """Voters, and how many toxic and other documents each fires in: ``most`` rows at the most."""
    a, b = F.col("toxic_docs"), F.col("other_docs")
    share = (a + b) / float(toxic + other)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
    evidence = part(a, float(toxic)) + part(b, float(other))
    lift = (a / float(toxic)) / ((b + 0.5) / float(other))
    top = counts.where(a >= SUPPORT).withColumn("_evidence", evidence).where((lift >= LIFT) & (F.col("_evidence") >= EVIDENCE))
    rows = sorted(top.orderBy(F.desc("_evidence"), "feature", "level").limit(most).collect(), key=lambda r: (r["feature"], r["level"]))
    base = np.array(sorted({r["feature"] for r in rows}), np.uint64)
    table = np.full((len(base), len(LEVELS)), -1, np.int64)
    for i, r in enumerate(rows):
        table[np.searchsorted(base, r["feature"]), LEVELS.index(r["level"])] = i
    return Voters(base, table, len(rows)), np.array([r["toxic_docs"] for r in rows], float), np.array([r["other_docs"] for r in rows], float)


def votes(data: np.ndarray, off: np.ndarray, voters: Voters) -> tuple[np.ndarray, np.ndarray]:
    """(text, voter) of each voter that fires, once for each text, by text."""
    doc, feature = features(data, off)
    if not voters.count or not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.uint64(FEATURE_BITS - 20)
    bits = np.zeros(1 << 20, bool)
    bits[(voters.base >> shift).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(feature >> shift).astype(np.int64)])
    at = np.minimum(np.searchsorted(voters.base, feature[maybe]), len(voters.base) - 1)
    hit = voters.base[at] == feature[maybe]
    doc, base, times = _counted(doc[maybe[hit]], at[hit].astype(np.uint64))
    fired = [(times >= level) & (voters.table[base.astype(np.int64), i] >= 0) for i, level in enumerate(LEVELS)]
    who = np.concatenate([doc[f] for f in fired])
    what = np.concatenate([voters.table[base[f].astype(np.int64), i] for i, f in enumerate(fired)])
    order = np.argsort(who, kind="stable")
    return who[order], what[order]


def label_model(doc: np.ndarray, voter: np.ndarray, n: int, prior: np.ndarray, share: float, rounds: int = 25) -> np.ndarray:
    """Posterior probability of the hidden label of n documents.

    ``prior`` holds, for each voter, the rates (in toxic, in other documents) that its
    estimates are drawn to.
    """
    m = len(prior)
    post = np.full(n, min(0.02, share))
    post[np.unique(doc)] = FIRST_GUESS
    silent = np.bincount(doc, minlength=n) == 0
    weight = np.ones(m)
    for turn in range(rounds):
        pos, neg = post.sum(), n - post.sum()
        p = (np.bincount(voter, post[doc], m) + PRIOR_ROWS * prior[:, 0]) / (pos + PRIOR_ROWS)
        q = (np.bincount(voter, 1 - post[doc], m) + PRIOR_ROWS * prior[:, 1]) / (neg + PRIOR_ROWS)
        if turn % 8 == 0:
            agree = _agreement(doc, voter, post)
            weight[: len(agree)] = 1 / agree
        pi = (pos + PRIOR_ROWS * share) / (n + PRIOR_ROWS)
        # A voter that does not fire abstains; that all abstain is a vote of its own.
        none = (post[silent].sum() + 1) / (pos + 2), ((1 - post)[silent].sum() + 1) / (neg + 2)
        logit = np.log(pi / (1 - pi)) + np.where(silent, np.log(none[0] / none[1]), 0.0)
        logit += np.bincount(doc, (weight * np.log(np.maximum(p, 1e-9) / np.maximum(q, 1e-9)))[voter], n)
        fresh = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(fresh - post).max() < 1e-6
        post = fresh
        if done:
            break
    return post


def _agreement(doc: np.ndarray, voter: np.ndarray, post: np.ndarray) -> np.ndarray:
    """For each voter, one plus its strong correlations with others in the toxic class."""
    m = int(voter.max()) + 1 if len(voter) else 0
    order = np.argsort(doc, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(doc[order]) != 0, True])
    together = np.zeros((m, m), np.float32)
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        v = voter[order[a:z]]
        together[np.ix_(v, v)] += post[doc[order[a]]]
    pos = max(post.sum(), 1.0)
    rate = np.diag(together) / pos
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    corr = (together / pos - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    return 1 + np.where(corr > STRONG, np.minimum(corr, 1), 0).sum(axis=1)


def fit_linear(doc: np.ndarray, voter: np.ndarray, n: int, m: int, target: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on votes, by gradient steps."""
    w, b = np.zeros(m), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    # A step for each voter by its own count, for the most votes a document has (so that all
    # steps together do not overshoot).
    most = float(np.bincount(doc, minlength=n).max()) if len(doc) else 1.0
    seen = np.bincount(voter, minlength=m) + RIDGE
    for _ in range(rounds):
        z = b + np.bincount(doc, w[voter], n)
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        w = w - (4.0 / most) * (np.bincount(voter, gap[doc], m) + RIDGE * w * 0.02) / seen
        b -= gap.sum() * 4.0 / n
    return w, b


def _training_rows(docs: DataFrame, marks: list[tuple[int, int]]) -> DataFrame:
    """(text lower-cased, toxic) of the documents whose ids are in ``marks``, without a shuffle."""
    ids = np.array([m[0] for m in marks], np.int64)
    toxic = np.array([m[1] for m in marks], np.int32)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            rows = np.flatnonzero(ids[at] == doc)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), pa.array(toxic[at[rows]])], names=["text", "toxic"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(picked, "text string, toxic int").select(F.lower("text").alias("text"), "toxic")


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic 0 or 1).

    Labels without an id or a mark are left out; several of one document count as the
    highest. At most about ``fit_rows`` labels, chosen by a hash of the id, are used.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
    marks = sorted((r["doc_id"], r["toxic"]) for r in known.collect())
    if not marks:
        return Model(Voters(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS)), np.int64), 0), np.zeros(0), float(np.log(1e-9)))
    rows = Scratch(docs.sparkSession, "toxicity").save(_training_rows(docs, marks), "training")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, toxic = int(sizes["n"]), int(sizes["t"])
    if not toxic or toxic == n:
        share = toxic / n if n else 0.0
        return Model(Voters(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS)), np.int64), 0), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    voters, bad, fine = choose_voters(feature_counts(rows), toxic, n - toxic)
    prior = np.stack([bad / toxic, (fine + 0.5) / (n - toxic)], axis=1) if voters.count else np.zeros((0, 2))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.bytes_of(batch.column(0))
            for lo, hi in _slices(off):
                doc, voter = votes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], voters)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(voter.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists], names=["voters"])

    # Equal sets of votes are one row with a count; the fit does not depend on their order.
    found = rows.select("text").mapInArrow(vote, "voters array<int>").groupBy("voters").count().collect()
    found = sorted((tuple(r["voters"]), r["count"]) for r in found)
    lists = [v for v, times in found for _ in range(times)]
    doc = np.repeat(np.arange(len(lists)), [len(v) for v in lists]) if lists else np.zeros(0, np.int64)
    voter = np.array([v for x in lists for v in x], np.int64)
    if not voters.count or not len(voter):
        return Model(voters, np.zeros(voters.count), float(np.log(toxic / (n - toxic))))
    post = label_model(doc, voter, len(lists), prior, toxic / n)
    weights, bias = fit_linear(doc, voter, len(lists), voters.count, post)
    return Model(voters, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` (text lower-cased here) without its text, with score and predicted."""
    rest = docs.drop(text, "score", "predicted")
    names = rest.columns
    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.bytes_of(batch.column(len(names)))
            for lo, hi in _slices(off):
                doc, voter = votes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], model.voters)
                z = model.bias + np.bincount(doc, model.weights[voter], hi - lo)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*names, F.lower(text).alias("_lower")).mapInArrow(scored, schema)
