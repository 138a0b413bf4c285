import random
import re
import zlib
from collections import Counter, defaultdict

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from tidemark.llm import variants as va
from tidemark.llm.queries import op13_spelling_variants


def corpus_words(rows, least=3):
    total = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_pairs(words):
    """All pairs one edit apart, by comparing the words that share a half."""
    by = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            by[w[:i] + w[i + 1 :]].add(w)
        by[w].add(w)
    return {(a, b) for group in by.values() for a in group for b in group if one_edit(a, b)}


def expected(words):
    near = defaultdict(set)
    for a, b in near_pairs(words):
        near[a].add(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_near_pairs_of_the_test_are_all(spark):
    words = ["abcde", "abcd", "abdce", "xbcde", "abcdef", "aabcde", "acde", "vwxyz"]
    assert near_pairs(words) == {(a, b) for a in words for b in words if one_edit(a, b)}


def documents(spark, rows):
    df = fx.documents(spark, rows).repartition(4)
    return df.select("*", *(F.lit(1).alias(c) for c in ("word", "n", "root", "form", "key", "run", "id", "other")))


def texts(seed=7):
    draw = random.Random(seed)
    letters = "abcdeàéÿ×÷Z"
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(40):
            w = draw.choice(base[: draw.randint(1, 60)])
            if draw.random() < 0.3:
                at, kind = draw.randrange(len(w)), draw.randrange(3)
                w = w[:at] + ("", draw.choice(letters), draw.choice(letters) + w[at])[kind] + w[at + 1 :]
            words.append(w)
        rows.append((i, draw.choice([" ", "-", "1", "\n", "İ"]).join(words)))
    tail = "q" * 63
    rows += [(900 + i, f"{tail}ab {tail}a {tail}abc {tail}b {tail} {tail}abcd a{tail}") for i in range(4)]
    return rows + [(None, "hello hello hello helo helo helo"), (None, None), (500, ""), (500, "word1word"), (500, "word1word"), (501, "y" * 1_000_000 + " tail")]


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_awkward_documents_against_all_pairs(spark, symbols):
    rows = texts()
    assert found(va.group_variants(documents(spark, rows), symbols=symbols)) == expected(corpus_words(rows))


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(op13_spelling_variants(spark, sf)) == expected(corpus_words(rows))


def test_roots_at_the_end_of_long_chains(spark):
    chain = ["abcdefgh"[: 5 + 0] + "x" * k for k in range(12)]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)))]
    words = corpus_words(rows)
    got = {r.word: r.root for r in va.group_variants(documents(spark, rows)).collect()}
    assert got == {w: r for w, _, _, _, _, r in expected(words)}
    assert len(set(got.values())) < len(got)


def test_ties_go_to_the_least_word(spark):
    rows = [(1, "aaaaab aaaaab aaaaab " + "zaaaaab " * 9 + "aaaaaba " * 9 + "aaaaac " * 9)]
    got = {r.word: r.form for r in va.group_variants(documents(spark, rows), one_in=10**9).collect()}
    assert got["aaaaab"] == "aaaaaba" and got["aaaaac"] is None


def test_empty_and_awkward_tables(spark):
    assert va.group_variants(fx.empty(spark)).collect() == []
    assert va.group_variants(fx.awkward(spark)).collect() == []


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_neighbourhoods_meet_every_near_word(symbols):
    draw = random.Random(symbols)
    for _ in range(3000):
        w = "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 8)))
        at = draw.randrange(len(w) + 1)
        other = [w[:at] + w[at + 1 :], w[:at] + draw.choice("abcxyz") + w[at + 1 :], w[:at] + draw.choice("abc") + w[at:]][draw.randrange(3)]
        if one_edit(w, other) and other:
            assert va.generated(w, symbols) & set(va.offered(other, symbols)), (w, other)


def test_words_that_only_share_a_reduced_word_do_not_meet():
    # One symbol: all words of a length have the same reduced word.
    draw = random.Random(3)
    words = {"".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(400)}
    offered = defaultdict(set)
    for w in words:
        for key in va.offered(w, 1):
            offered[key].add(w)
    met = sum(len(offered[key] - {w}) for w in words for key in va.generated(w, 1))
    assert met < len(words)
