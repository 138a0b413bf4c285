import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import fixtures as fx
from tidemark.llm import decontam as dc
from tidemark.llm import licenses as lc
from tidemark.llm import queries as q
from tidemark.llm import toxicity as tq
from tidemark.llm import wordpiece as wp
from tidemark.llm.language import distances, identify, learn_profiles
from tidemark.llm.mixing import balance, mix_sources
from tidemark.llm.quality import GAMMA, quality_filter, quartiles, sketch
from tidemark.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


def test_automaton_is_greedy_longest_match():
    draw = random.Random(1)
    pieces = {bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 6))) for _ in range(60)} | {"▁".encode(), "▁ab".encode(), "é".encode()}
    a = wp.build(pieces)
    known = pieces | {bytes([c]) for c in range(256)}
    words = [bytes(draw.choice(b"abcd") for _ in range(draw.randint(1, 30))) for _ in range(300)] + ["éaé日".encode(), b"a" * 2000]
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(x) + 1 for x in words]) - 1
    start = end - [len(x) for x in words]
    for word, n in zip(words, wp.count_pieces(data, start, end, a).tolist()):
        rest, count = "▁".encode() + word, 0
        while rest:
            size = next(k for k in range(len(rest), 0, -1) if rest[:k] in known)
            rest, count = rest[size:], count + 1
        assert n == count


def test_token_counts_of_awkward_rows(spark):
    pieces = [b"a", b"b", "▁a".encode(), "▁".encode()]
    found = wp.count_tokens(fx.awkward(spark).select("doc_id", "text"), pieces).collect()
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in found) == {
        (None, 0, 0): 1, (1, 3, 5): 2, (2, 0, 0): 1, (None, 3, 5): 1, (3, 0, 0): 1,
    }
    assert wp.count_tokens(fx.empty(spark), pieces).collect() == []


def test_out_of_place_distance():
    from tidemark.llm.language import Profiles, counted, grams

    keys, times = counted(grams(["aab"], np.array([0])))
    order = np.lexsort((keys, -times))
    profile = Profiles(["x", "y"], keys, np.stack([np.argsort(order), np.full(len(keys), -1)], axis=1).astype(np.int32))
    found, used = distances(["aab", "", "12 3"], profile, 300)
    assert found[0].tolist() == [0, 300 * len(keys)] and used.tolist() == [len(keys), 0, 0]
    # 1-grams a b, 2-grams _a aa ab b_, 3-grams _aa aab ab_.
    assert len(keys) == 9 and times.max() == 2


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = q.op3_language_id(spark, SF).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(truth) and 0.2 < len(held) / len(found) < 0.3
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_awkward_rows(spark):
    rows = fx.awkward(spark)
    profiles = learn_profiles(rows)
    found = identify(rows, profiles).collect()
    assert Counter(r.lang_pred for r in found) == {"und": 3, "en": 3}
    assert learn_profiles(fx.empty(spark)).names == []
    assert {r.lang_pred for r in identify(rows, learn_profiles(fx.empty(spark))).collect()} == {"und"}


def test_license_matches_with_edits():
    template = lc.TEMPLATES["MIT-text"]
    words = template.split()
    edited = [w for i, w in enumerate(words) if i not in (10, 40)] + ["tail"]
    edited.insert(25, "odd")
    index = lc.index_of(lc.TEMPLATES)
    texts = [f"intro {template} end", " ".join(edited), "All rights reserved. All Rights Reserved!", "no license", "", None]
    import pyarrow as pa

    from tidemark.llm import text as tx

    data, off = tx.bytes_of(pa.array(texts))
    w, hashes = lc.plain_words(data, off)
    found = [(d, index.names[t], m, s, e) for d, t, m, s, e in lc.scan(hashes, w.first, index, 0.8)]
    n = len(index.words[index.names.index("MIT-text")])
    assert (0, "MIT-text", n, 1, 1 + n) in found
    assert [x[2] for x in found if x[0] == 1 and x[1] == "MIT-text"] == [n - 2]
    assert [x[3:] for x in found if x[0] == 2] == [(0, 3), (3, 6)]
    assert {x[0] for x in found} == {0, 1, 2}


def test_alignment_is_a_common_subsequence():
    draw = np.random.default_rng(3)
    for _ in range(50):
        a, b = draw.integers(0, 4, 9), draw.integers(0, 4, 14)
        matched, _, _ = lc.align(b.astype(np.uint64), a.astype(np.uint64), -20, 20)
        assert matched == dc.common_subsequence(a, b) == _lcs(a.tolist(), b.tolist())


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_license_lines_are_found(spark):
    lines = {"CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "MIT": "Released under the MIT License"}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = q.op4_license_scan(spark, SF).collect()
    for name, line in lines.items():
        wanted = Counter({r.doc_id: r.text.count(line) for r in rows if line in r.text})
        assert Counter(r.doc_id for r in found if r.license == name) == wanted and wanted
    assert lc.scan_licenses(fx.empty(spark)).collect() == [] and lc.scan_licenses(fx.awkward(spark)).collect() == []


def test_leaks_are_found_and_nothing_else(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    wanted = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert {(r.doc_id, r.item_id) for r in q.op7_decontaminate(spark, SF).collect()} == wanted and wanted


def test_paraphrases_are_found(spark):
    draw = random.Random(6)
    item = fx.sentence(draw, 40)
    words = item.split()
    changed = [w if i % 4 or i > 30 else fx.sentence(draw, 1) for i, w in enumerate(words)]
    rows = [(i, fx.sentence(draw, 200)) for i in range(40)]
    rows += [(100, f"{fx.sentence(draw, 50)} {' '.join(changed)} {fx.sentence(draw, 50)}"), (101, " ".join(words[:12])), (102, None), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, None), (None, "x"), (9, "too short"), (10, " .,; ")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.coverage for r in dc.find_leaks(fx.documents(spark, rows), bench).collect()}
    assert set(found) == {(100, 7), (None, 7)} and found[100, 7] < 1 == found[None, 7]


def test_short_and_widespread_items_are_found_word_for_word(spark):
    bench = spark.createDataFrame([(1, "What is the capital"), (2, "of the of"), (3, "zebra"), (4, "one two three four five six seven")], "item_id long, text string")
    rows = [(1, "so: what is THE capital?"), (2, "what is the big capital"), (3, "of the of the of"), (4, "the of the"), (5, "a zebra."), (6, "zebras"), (None, "what is the capital")]
    rows += [(10 + i, f"{i} one two three four five six seven") for i in range(20)]
    found = {(r.doc_id, r.item_id, r.word_start) for r in dc.find_leaks(fx.documents(spark, rows), bench).collect()}
    assert found == {(1, 1, 1), (None, 1, 0), (3, 2, 0), (5, 3, 1)} | {(10 + i, 4, 1) for i in range(20)}
    # A document that is the item, alone in its corpus.
    alone = fx.documents(spark, [(1, "one two three four five six seven")])
    assert [(r.doc_id, r.item_id) for r in dc.find_leaks(alone, bench).collect()] == [(1, 4)]


def test_items_in_blocks_and_reads_are_found_alike(spark, monkeypatch):
    draw = random.Random(13)
    items = {i: fx.sentence(draw, n) for i, n in enumerate((3, 9, 16, 22, 35, 60, 18))}
    rows = [(i, f"{fx.sentence(draw, 40)} {items[i % 7]} {fx.sentence(draw, 40)}") for i in range(30)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = fx.documents(spark, rows)
    wanted = {(i, i % 7) for i in range(30)}
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()} >= wanted
    monkeypatch.setattr(dc, "ITEMS", 2)
    monkeypatch.setattr(dc, "READ_ITEMS", 4)
    monkeypatch.setattr(dc, "FIT_BYTES", 500)
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()} >= wanted


def test_the_space_is_fitted_on_all_documents(spark, monkeypatch):
    # More than 8 MB of packed words; no two documents have the same places.
    rows = [(i, "unknown " * i + "alpha beta gamma delta even " * 6_000) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha even beta gamma delta epsilon")], "item_id long, text string")
    fitted, plain = [], dc.latent_space

    def fit(hits, items, to, idf, **more):
        fitted.append((hits.count(), dc.total_bytes(hits)))
        return plain(hits, items, to, idf, **more)

    monkeypatch.setattr(dc, "latent_space", fit)
    dc.find_leaks(docs, bench).collect()
    assert fitted == [(80, 80 * 30_000 * 4)]


def test_products_are_those_of_the_passages(spark):
    draw = random.Random(14)
    texts = [fx.sentence(draw, n) for n in (1, 15, 16, 17, 40, 200)]
    # A cell without a word of the benchmark ends a passage.
    texts += [f"{texts[3]} {'... '.join(['unknown'] * 40)} {texts[4]}"]
    items = dc.read_items([(1, " ".join(texts[:5]).lower())])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = dc.find_words(docs, items.vocabulary)
    size = len(items.vocabulary)
    idf = np.random.default_rng(1).random(size)
    idf[::3] = 0
    rows = []
    for r in hits.collect():
        place, word = np.frombuffer(r.places, np.int32) // dc.CELL, np.frombuffer(r.words, np.int32)
        rows += [np.bincount(word[(place == c) | (place == c + 1)], minlength=size) * idf for c in np.unique(place)]
    x, right = np.array(rows), np.random.default_rng(2).standard_normal((size, 5))
    to = np.arange(size, dtype=np.int32)
    assert np.allclose(dc._product(hits, to, idf, right, gram=False), x.T @ (x @ right), atol=1e-3)
    assert np.allclose(dc._product(hits, to, idf, right, gram=True), right.T @ x.T @ x @ right, atol=1e-3)


def test_the_space_decides_candidates():
    draw = np.random.default_rng(2)
    texts = [" ".join(f"w{j}" for j in draw.integers(0, 200, 30)) for _ in range(20)]
    items = dc.read_items(list(enumerate(texts)))
    idf = np.ones(len(items.vocabulary))
    words = np.concatenate([draw.permutation(np.concatenate(items.words))[:4000]]).astype(np.int32)
    f = dc.Found(np.arange(len(words), dtype=np.int32), words, np.array([0, len(words)]), np.zeros(len(words), np.int64))
    pieces = dc.piece_vectors(items, idf)
    _, _, right = np.linalg.svd(pieces)
    low = dc.near_windows(f, dc.prepare(items, idf, right[:10].T), idf, dc.NEAR)
    full = dc.near_windows(f, dc.prepare(items, idf, np.eye(len(idf))), idf, dc.NEAR)
    assert set(zip(low[0], low[1])) != set(zip(full[0], full[1]))


def _windows_by_the_word(f, items, idf, space, near):
    """All windows near a piece, one by one: (row, piece) to cosine."""
    found, vectors = {}, dc.piece_vectors(items, idf)
    for q, (i, a, b) in enumerate(zip(items.piece_item, items.piece_from, items.piece_to)):
        own, size = {w for w in items.words[i][a:b].tolist() if idf[w]}, b - a
        unit = vectors[q] @ space / max(np.linalg.norm(vectors[q] @ space), 1e-12)
        least = max(1, int(np.ceil(dc.SHARE * (idf[items.words[i][a:b]] > 0).sum())))
        for row in range(len(f.word)):
            inside = (f.doc == f.doc[row]) & (f.place >= f.place[row]) & (f.place < f.place[row] + size)
            if f.word[row] not in own or sum(w in own for w in f.word[inside].tolist()) < least:
                continue
            x = np.bincount(f.word[inside], minlength=len(idf)) * idf
            if x @ space @ unit >= near * min(np.linalg.norm(x), np.linalg.norm(vectors[q])):
                found[row, q] = x @ space @ unit / np.linalg.norm(x)
    return found


def test_windows_are_those_found_one_by_one(monkeypatch):
    draw = np.random.default_rng(8)
    items = dc.read_items([(i, " ".join(f"w{j}" for j in draw.integers(0, 60, n))) for i, n in enumerate((5, 7, 15, 16, 16, 21, 50))])
    idf = draw.random(len(items.vocabulary))
    idf[::7] = 0
    space, _ = np.linalg.qr(draw.standard_normal((len(idf), 12)))
    n = 600
    words, doc = draw.integers(0, len(idf), n).astype(np.int32), np.sort(draw.integers(0, 9, n))
    # Gaps of every width, some far wider than a window.
    step = np.where(draw.random(n) < 0.9, draw.integers(1, 4, n), draw.integers(10, 10**6, n))
    place = np.concatenate([np.cumsum(step[doc == d]) for d in range(9)]).astype(np.int32)
    f = dc.Found(place, words, np.searchsorted(doc, np.arange(10)), doc)
    for size in (dc.WINDOWS, 50):
        monkeypatch.setattr(dc, "WINDOWS", size)
        row, piece, cosine = dc.near_windows(f, dc.prepare(items, idf, space), idf, 0.2)
        wanted = _windows_by_the_word(f, items, idf, space, 0.2)
        found = dict(zip(zip(row.tolist(), piece.tolist()), cosine.tolist()))
        assert len(found) == len(row) > 20 and found.keys() == wanted.keys()
        assert all(found[k] == pytest.approx(wanted[k], abs=1e-5) for k in wanted)


class _InThisProcess:
    """Stands for a table whose task is called by the test."""

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        return task


def test_surroundings_without_the_answer_are_not_compared(monkeypatch):
    item = [f"w{i}" for i in range(20)]
    items = dc.read_items([(1, " ".join(item))])
    number = {w: int(np.searchsorted(items.vocabulary, dc.read_items([(0, w)]).vocabulary[0])) for w in item}
    texts = [[w for w in item if w not in item[i : 16 : 4]] for i in range(4)]
    # Two thirds of the item without its answer, backwards too.
    texts += [item[:13], item[12::-1], item]
    places = [np.arange(len(x), dtype=np.int32).tobytes() for x in texts]
    packed = [np.array([number[w] for w in x], np.int32).tobytes() for x in texts]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "places": pa.array(places, pa.binary()), "words": pa.array(packed, pa.binary())})
    idf, compared, plain = np.ones(20), [], dc.common_subsequence

    def compare(whole, text):
        compared.append(len(text))
        return plain(whole, text)

    monkeypatch.setattr(dc, "common_subsequence", compare)
    task = dc.search(_InThisProcess(), items, np.arange(20, dtype=np.int32), np.ones(20, np.int64), idf, np.eye(20), dc.NEAR, 0.75, 0.5)
    found = {d: c for out in task(iter([batch])) for d, c in zip(out["doc_id"].to_pylist(), out["coverage"].to_pylist())}
    assert found == {i: pytest.approx(len(texts[i]) / 20) for i in (0, 1, 2, 3, 6)}
    # None for the two without the answer, two for each that is found and no copy.
    assert len(compared) == 8


def test_leaks_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert dc.find_leaks(fx.awkward(spark), none).collect() == []
    assert dc.find_leaks(fx.empty(spark), some).collect() == []
    assert dc.find_leaks(fx.awkward(spark), some).collect() == []


def test_toxic_documents(spark):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    found = [r for r in q.op6_toxicity(spark, "/root/testdata/sf0.1").collect()]
    held = [(marks[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in marks]
    caught = np.mean([p for t, p in held if t])
    false = np.mean([p for t, p in held if not t])
    assert caught > 0.8 and false < 0.04
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_toxicity_without_labels(spark):
    docs = fx.awkward(spark).select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id long, toxic int")
    for labels in (none, odd, docs.select("doc_id", F.lit(0).alias("toxic")), docs.select("doc_id", F.lit(1).alias("toxic"))):
        found = tq.score(docs, tq.learn(docs, labels)).collect()
        assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)


def test_label_model_finds_the_hidden_label():
    draw = np.random.default_rng(1)
    n, m = 3000, 12
    truth = draw.random(n) < 0.2
    # Silent voters abstain: those that fire wrongly do so seldom.
    fires = draw.random((n, m)) < np.where(truth[:, None], 0.4, 0.003)
    fires = np.concatenate([fires, fires[:, :1], fires[:, :1]], axis=1)  # three voters say the same
    doc, voter = np.nonzero(fires)
    prior = np.stack([np.full(m + 2, 0.4), np.full(m + 2, 0.05)], axis=1)
    post = tq.label_model(doc, voter, n, prior, 0.2)
    assert ((post > 0.5) == truth).mean() > 0.95
    weights, bias = tq.fit_linear(doc, voter, n, m + 2, post)
    score = 1 / (1 + np.exp(-(bias + np.bincount(doc, weights[voter], n))))
    assert ((score > 0.5) == truth).mean() > 0.95


def test_mix_meets_targets(spark):
    found = q.op8_mix_sources(spark, SF).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(len(brute.words(texts[r.doc_id])) == r["size"] for _, r in found.iterrows())
    by = found.groupby("source")
    total, want = found["size"].sum(), {}
    order = sorted(by.groups)
    mass = by["size"].sum().to_dict()
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    open_, left = set(order), float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * mass[s] + 1e-9]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * mass[s]
            open_.discard(s)
            left -= want[s]
    want |= share
    for s, rows in by:
        assert rows["target"].iloc[0] == pytest.approx(want[s]) and rows["source_size"].iloc[0] == mass[s]
        assert abs(rows["taken"].sum() - want[s]) <= 0.02 * want[s]
    assert (found["taken"] <= 3 * found["size"]).all()
    again = q.op8_mix_sources(spark, SF).toPandas()
    assert sorted(zip(found.doc_id, found.taken)) == sorted(zip(again.doc_id, again.taken))


def test_capped_sources_and_awkward_rows(spark):
    rows = [(1, "a " * 10, "en", "a", 1), (2, "b " * 100, "en", "b", 1), (3, None, "en", "c", 1), (4, "z " * 50, "en", None, 1)]
    found = {r.doc_id: r for r in mix_sources(spark.createDataFrame(rows, fx.DOCUMENTS), [5, 2, 1]).collect()}
    assert found[1].target == 30 and found[1].taken == 30 and found[3].target == 0 == found[3].taken
    assert found[2].target + found[4].target == pytest.approx(130) and found[4].target == pytest.approx(130 * 5 / 7)
    assert mix_sources(fx.empty(spark), [5, 2, 1]).collect() == []
    found = mix_sources(fx.awkward(spark), [5, 2, 1]).collect()
    assert len(found) == 6 and all(0 <= r.taken <= 3 * r.size for r in found)


def test_two_margins_are_balanced(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 40), ("b", "y", 20)], "s string, l string, mass long")
    one = spark.createDataFrame([("a", 60.0), ("b", 40.0)], "s string, target double")
    two = spark.createDataFrame([("x", 50.0), ("y", 50.0)], "l string, target double")
    done = balance(cells, {"s": one, "l": two}, Scratch(spark, "test")).withColumn("w", F.col("mass") * F.exp("_tilt"))
    for column, targets in (("s", {"a": 60, "b": 40}), ("l", {"x": 50, "y": 50})):
        for r in done.groupBy(column).agg(F.sum("w").alias("w")).collect():
            assert r.w == pytest.approx(targets[r[0]], rel=1e-4)


def test_quality_counts(spark):
    rows = fx.corpus(13) + [(5000, "a b c d e " * 4), (5001, "#x *y\n\nl m\nl m\n l m"), (5002, "one two three four five six seven eight nine ten")]
    found = quality_filter(fx.documents(spark, rows)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found}
    assert got == {i: brute.quality(t) for i, t in rows}
    assert not any(r.kept and r.base_failed for r in found)


def test_quality_keeps_clean_documents(spark):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = [(good[r.doc_id], r.kept) for r in q.op9_quality_rules(spark, SF).collect() if r.doc_id in good and not r.base_failed]
    assert all(k for g, k in found if g) and np.mean([k for g, k in found if not g]) < 0.2


def test_sketches_merge_and_bound_their_error(spark):
    values = np.random.default_rng(0).lognormal(0, 1, 4000)
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "half int, v double")
    whole = quartiles(sketch(df, [], {"v": F.col("v")}), []).first()
    merged = quartiles(sketch(df, ["half"], {"v": F.col("v")}).drop("half"), []).first()
    assert whole == merged
    for q_, found in ((0.25, whole.q1), (0.75, whole.q3)):
        assert found == pytest.approx(np.quantile(values, q_), rel=GAMMA - 1 + 0.005)


def test_quality_of_awkward_rows(spark):
    assert quality_filter(fx.empty(spark)).collect() == []
    assert [r.kept for r in quality_filter(fx.awkward(spark)).collect()] == [False] * 6


def _replaced(draw, words, share):
    """Words with a share of them, all before the answer, replaced by new ones."""
    before = len(words) - max(3, len(words) // 5)
    gone = set(draw.sample(range(before), round(share * len(words))))
    return [f"new{draw.randrange(10**9)}" if i in gone else w for i, w in enumerate(words)]


def test_paraphrases_are_found_in_any_number_of_documents(spark, monkeypatch):
    draw = random.Random(11)
    common = sorted({fx.sentence(draw, 1) for _ in range(400)})
    items = {i: [draw.choice(common) for _ in range(n)] for i, n in enumerate((15, 16, 23, 30, 38, 47, 59))}
    rows = [(i, " ".join(draw.choice(common) if draw.random() < 0.2 else f"w{draw.randrange(10**9)}" for _ in range(300))) for i in range(150)]
    wanted = set()
    for share in (0.25, 0.3, 0.4):
        for i, words in items.items():
            for _ in range(4):
                around = [" ".join(f"w{draw.randrange(10**9)}" for _ in range(draw.randint(10, 60))) for _ in range(2)]
                wanted.add((1000 + len(wanted), i))
                rows.append((999 + len(wanted), f"{around[0]} {' '.join(_replaced(draw, words, share))} {around[1]}"))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    docs = fx.documents(spark, rows)
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()} == wanted
    plain, large = dc.inverse_frequencies, 10_000_000
    monkeypatch.setattr(dc, "inverse_frequencies", lambda counts, n: plain(counts * (large / n), large))
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()} == wanted


def test_copies_beside_repeated_item_words_are_found(spark):
    draw = random.Random(12)
    rows, wanted = [(i, fx.sentence(draw, 200)) for i in range(40)], set()
    items = {i: [f"t{i}x{j}" for j in range(n)] for i, n in enumerate((16, 20, 31, 45, 59))}
    for i, words in items.items():
        for times in (30, 70, 200, 600):
            again = " ".join([words[3]] * times)
            wanted |= {(1000 + len(wanted), i), (1001 + len(wanted), i)}
            rows.append((998 + len(wanted), f"{' '.join(words)} {again}"))
            rows.append((999 + len(wanted), f"{again} {' '.join(words)} {again}"))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    found = dc.find_leaks(fx.documents(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted
    assert all(r.coverage == 1 and r.cosine < 1.01 for r in found)


def test_a_long_document_does_not_keep_a_source_from_its_target(spark):
    rows = [(i, None, "en", "a", 100_000 if i == 7 else 100) for i in range(1000)]
    rows += [(1000 + i, None, "en", "b", 1000) for i in range(100)]
    docs = spark.createDataFrame(rows, fx.DOCUMENTS)
    for seed in (0, 1, 2):
        found = mix_sources(docs, [100, 305], size=docs["n_chars"], seed=seed).where("source = 'a'").collect()
        assert len(found) == 1000 and 0.3 < found[0].rate < 0.4
        assert abs(sum(r.taken for r in found) - found[0].target) <= 50
