"""Cases that every operator has to take: very long texts and words, ties, lost packages."""

import os
import random
import subprocess
import sys

import corpus_pipeline as cp
import fixtures as fx
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam as dc
from tidemark.llm import wordpiece as wp
from tidemark.llm.language import identify, learn_profiles
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import quality_filter
from tidemark.llm.toxicity import learn, score

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def long_rows():
    """A megabyte of words, one word of a megabyte, and the same again."""
    words = " ".join(f"kalo{i % 997} miru" for i in range(90_000))
    rows = [(1, f"{words} {ITEM} {words}"), (2, "z" * 1_200_000), (3, "tor vel " * 3), (4, None)]
    return rows + [(i + 10, t) for i, t in rows]


def same(found, columns):
    rows = {r.doc_id: tuple(r[c] for c in columns) for r in found}
    assert all(rows[i] == rows[i + 10] for i in (1, 2, 3, 4))
    return rows


def test_long_texts_in_every_operator(spark):
    docs = fx.documents(spark, long_rows())
    pieces = [bytes([c]) for c in range(256)] + ["▁".encode(), "▁kalo".encode(), b"zz"]
    tokens = same(wp.count_tokens(docs.select("doc_id", "text"), pieces).collect(), ["n_words", "n_tokens"])
    assert tokens[2] == (1, 1 + 600_000) and tokens[1][0] == 2 * 180_000 + 12
    profiles = learn_profiles(docs)
    assert same(identify(docs, profiles).collect(), ["lang_pred", "score"])[4] == ("und", 0.0)
    assert scan_licenses(docs).collect() == []
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    named = docs.select("doc_id", "text")
    same(score(named, learn(named, labels)).collect(), ["score", "predicted"])
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.word_start) for r in dc.find_leaks(docs, bench).collect()} == {(1, 7, 180_000), (11, 7, 180_000)}
    sizes = same(mix_sources(docs.withColumn("source", F.lit("a")), [1]).collect(), ["size"])
    assert sizes[1] == (360_012,) and sizes[2] == (1,)
    quality = same(quality_filter(docs).collect(), ["n_words", "word_chars", "kept"])
    assert quality[2] == (1, 1_200_000, False)


def test_ties(spark):
    """Equal distances go to the first language; equal documents share a mix fairly."""
    rows = [(i, "aaa bbb", lang, "s", 7) for i, lang in enumerate(("nl", "de", "nl", "de"))]
    docs = spark.createDataFrame(rows, fx.DOCUMENTS)
    assert {r.lang_pred for r in identify(docs, learn_profiles(docs)).collect()} == {"de"}
    equal = spark.createDataFrame([(i, "a b c d e f g h i j", "en", f"s{i % 2}", 19) for i in range(40)], fx.DOCUMENTS)
    taken = mix_sources(equal, [1, 1]).collect()
    assert sum(r.taken for r in taken) == 400 and {r.target for r in taken} == {200.0}


def test_overlapping_templates_report_each(spark):
    from tidemark.llm import licenses as lc

    text = list(lc.TEMPLATES.values())[0]
    found = scan_licenses(fx.documents(spark, [(1, text), (2, f"{text}\n{text}")])).collect()
    assert {r.doc_id for r in found} == {1, 2}
    assert len([r for r in found if r.doc_id == 2]) >= 2 * len([r for r in found if r.doc_id == 1])


def test_paraphrases_against_an_exhaustive_search(spark):
    """Every document against every item by longest common subsequence: at least nine of ten
    pairs that it accepts are found, and nothing that it does not."""
    draw = random.Random(21)
    common = sorted({fx.sentence(draw, 1) for _ in range(300)})
    items = {i: [draw.choice(common) for _ in range(draw.randint(8, 60))] for i in range(25)}
    rows, near = [], {}
    for d in range(200):
        words = [draw.choice(common) if draw.random() < 0.3 else f"n{draw.randrange(10**8)}" for _ in range(80)]
        if d % 2:
            item = items[d % 25]
            kept = [w for w in item if draw.random() > draw.choice([0, 0.25, 0.4])]
            words[40:40] = [x for w in kept for x in ([w] if draw.random() > 0.1 else [w, f"n{draw.randrange(10**8)}"])]
        rows.append((d, " ".join(words)))
        near[d] = words
    number = {w: i for i, w in enumerate({w for x in [*items.values(), *near.values()] for w in x})}
    import numpy as np

    def accepted(item, words):
        item, words = (np.array([number[w] for w in x]) for x in (item, words))
        best = 0.0
        for lo in range(0, len(words), 4):
            window = words[lo : lo + len(item) + 2 * dc.CELL]
            cover = dc.common_subsequence(item, window) / len(item)
            answer = item[-max(3, len(item) // 5) :]
            if cover >= 0.75 or (cover >= 0.5 and dc.common_subsequence(answer, window) / len(answer) >= 0.8):
                best = max(best, cover)
        return best

    wanted = {(d, i) for d, words in near.items() for i, item in items.items() if accepted(item, words)}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.find_leaks(fx.documents(spark, rows), bench).collect()}
    assert len(wanted) > 60
    assert len(found & wanted) >= 0.9 * len(wanted)
    whole = {(d, i) for d, i in found if dc.common_subsequence(*(np.array([number[w] for w in x]) for x in (items[i], near[d]))) >= len(items[i]) / 2}
    assert found == whole


def _fresh(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("module", ["decontam", "rlz", "suffixes", "whitening"])
def test_fresh_workers_have_what_they_use(module):
    code = f"import tidemark.llm.{module} as m; assert m.pc.sum([1, 2]).as_py() == 3"
    found = _fresh(code)
    assert found.returncode == 0, found.stderr


def test_queries_are_there_without_the_tokenizer_package():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    found = _fresh(code)
    assert found.returncode == 0 and int(found.stdout) > 70, found.stderr


def test_pipeline_stages_tell_rows_apart_that_share_an_id_or_have_none(spark):
    draw = random.Random(2)
    texts = [fx.sentence(draw, 60) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (2, texts[1]), (3, texts[2]), (None, texts[3]), (None, texts[2])]
    kept = cp.minhash_dedup(spark, fx.documents(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, texts.index(r.text)) for r in kept) == [(0, 2), (0, 3), (1, 0), (2, 1), (3, 2)]


def test_pipeline_removes_leaks_without_an_id(spark, tmp_path):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"so {ITEM}"), (None, "clean words only"), (5, "clean too"), (5, f"{ITEM} again")]
    kept = cp.decontaminate(spark, fx.documents(spark, rows), str(tmp_path)).collect()
    assert sorted(r.text for r in kept) == ["clean too", "clean words only"]
