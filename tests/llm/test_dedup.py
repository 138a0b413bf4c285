import random

import numpy as np
import pytest

import brute
import fixtures as fx
from tidemark.llm import suffixes as sx
from tidemark.llm import text as tx
from tidemark.llm.minhash import bands_for, near_duplicates
from tidemark.llm.rlz import dedup_substrings
from tidemark.llm.suffixes import dedup_suffixes


@pytest.mark.parametrize("seed", [1, 2])
def test_rlz_removes_what_starts_earlier(spark, seed):
    rows = fx.corpus(seed)
    found = dedup_substrings(fx.documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute.window_dedup(rows)
    assert any(r.n_removed for r in found) and any(r.n_factors for r in found)


def test_rlz_window_and_spans(spark):
    rows = [(1, "a b c d e f g h"), (2, "x b c d e y"), (3, "b c d"), (4, "q q q q q q")]
    found = {r.doc_id: r for r in dedup_substrings(fx.documents(spark, rows), window=3).collect()}
    wanted = brute.window_dedup(rows, 3)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found.items()} == wanted
    assert [tuple(s) for s in found[2].spans] == [(1, 4)] and found[2].kept_text == "x y"


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_remove_what_smaller_ids_have(spark, seed):
    rows = fx.corpus(seed)
    found = dedup_suffixes(fx.documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute.span_dedup(rows)
    assert any(r.n_removed for r in found)


def test_suffixes_of_other_spans(spark):
    rows = fx.corpus(5, 40)
    found = dedup_suffixes(fx.documents(spark, rows), span=12).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute.span_dedup(rows, 12)


def test_loser_tree_merges_and_knows_shared_lengths():
    draw = random.Random(4)
    runs = []
    for _ in range(7):
        strings = sorted({bytes(draw.choice(b"ab") for _ in range(9)) + bytes([draw.randrange(256)]) for _ in range(draw.randint(0, 40))})
        shared = [0] + [next((i for i in range(10) if a[i] != b[i]), 10) for a, b in zip(strings, strings[1:])]
        runs.append((strings, shared[: len(strings)]))
    order, shared = sx.merge_runs(runs, 10)
    at = [0] * 7
    merged = []
    for run in order:
        merged.append(runs[run][0][at[run]])
        at[run] += 1
    assert merged == sorted(s for strings, _ in runs for s in strings)
    for a, b, n in zip(merged, merged[1:], shared[1:]):
        assert n == next((i for i in range(10) if a[i] != b[i]), 10)


def test_front_coding_round_trip():
    draw = np.random.default_rng(2)
    rows = np.unique(draw.integers(97, 100, (200, 12)).astype(np.uint8), axis=0)
    doc = draw.integers(-5, 99, len(rows))
    back, _, ids = sx.read_run(sx.front_code(rows, doc), 12)
    assert (back == rows).all() and (ids == doc).all()


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_exact_components(spark, k, percent):
    rows = fx.corpus(7)
    found = near_duplicates(fx.documents(spark, rows), k=k, percent=percent).collect()
    wanted = brute.near_components(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert any(not r.kept for r in found)


def test_near_copies_without_a_common_hub(spark):
    """Copies that differ from their original, but link in chains that no hub sees."""
    draw = random.Random(9)
    words = fx.sentence(draw, 120).split()
    rows = []
    for i in range(60):
        if i % 4 == 0:
            words[draw.randrange(120)] = f"new{i}"
        mine = list(words)
        mine[draw.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(mine)))
    found = near_duplicates(fx.documents(spark, rows), k=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_components(rows, 3, 85)


def test_buckets_in_chunks(spark, monkeypatch):
    from tidemark.llm import minhash

    monkeypatch.setattr(minhash, "BUCKET", 8)
    rows = fx.corpus(11)
    found = near_duplicates(fx.documents(spark, rows), k=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_components(rows, 3, 85)


def test_bands_miss_at_most_one_in_a_million():
    for percent in (50, 80, 85, 95):
        rows, bands = bands_for(percent / 100)
        assert bands % 2 == 0 and (1 - (percent / 100) ** rows) ** bands <= 1e-6


@pytest.mark.parametrize("operator", [dedup_substrings, dedup_suffixes, near_duplicates])
def test_awkward_rows(spark, operator):
    assert operator(fx.empty(spark)).collect() == []
    found = operator(fx.awkward(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 1), (False, 1), (False, 2), (False, 3), (True, 0), (True, 0)]


def test_words_are_runs_of_other_bytes():
    import pyarrow as pa

    texts = ["a  bé\tc", "", None, "\n", "x"]
    data, off = tx.bytes_of(pa.array(texts))
    w = tx.words(data, off)
    got = [data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
    assert got == ["a", "bé", "c", "x"] and w.first.tolist() == [0, 3, 3, 3, 3, 4]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 11, 20])
def test_window_hashes_are_of_the_window(k):
    items = np.random.default_rng(k).integers(0, 3, 300).astype(np.uint64)
    found = tx.window_hashes(items, k)
    seen = {}
    for i, h in enumerate(found.tolist()):
        assert seen.setdefault(tuple(items[i : i + k]), h) == h
    assert len(set(seen.values())) == len(seen) and len(found) == 300 - k + 1
