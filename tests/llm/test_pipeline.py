from collections import Counter

import brute
import corpus_pipeline as cp
import fixtures as fx
from tidemark.llm import decontam as dc

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = {r.doc_id: r for r in docs.collect()}
        if name != "mix":
            assert docs.columns == columns
        if name == "language_id":
            assert set(rows) == set(before)
        if name == "minhash_dedup":
            groups = brute.near_components(list(before.items()), 5, 80)
            assert set(rows) == {i for i, (_, c) in groups.items() if i == c}
        if name == "suffix_dedup":
            wanted = brute.span_dedup(list(before.items()))
            assert {i: len((r.text or "").encode()) for i, r in rows.items()} == {
                i: w[0] - w[1] for i, w in wanted.items() if i in rows
            }
            assert all(w[1] for i, w in wanted.items() if i not in rows)
        if name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(rows) == {i for i, t in before.items() if not any(x in t for x in items)}
        if name == "mix":
            assert set(rows) == set(before)
    found = cp.run(spark, SF).collect()
    assert Counter((r.doc_id, r.taken) for r in found) == Counter((i, r.taken) for i, r in rows.items())


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    for label, docs in (("awkward", fx.awkward(spark)), ("empty", fx.empty(spark))):
        columns = docs.columns
        for name, stage in cp.STAGES:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{label}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{label}/{name}")
            assert name == "mix" or docs.columns == columns
        assert docs.count() == (2 if label == "awkward" else 0)


def test_decontaminate_fits_its_space_on_all_documents(spark, tmp_path, monkeypatch):
    # More than 8 MB of packed words; no two documents have the same places.
    rows = [(i, "unknown " * i + "alpha beta gamma delta even " * 6_000) for i in range(80)]
    bench = spark.createDataFrame([(1, "alpha even beta gamma delta epsilon")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    fitted, plain = [], dc.latent_space

    def fit(hits, items, to, idf, **more):
        fitted.append(hits.count())
        return plain(hits, items, to, idf, **more)

    monkeypatch.setattr(dc, "latent_space", fit)
    cp.decontaminate(spark, fx.documents(spark, rows), str(tmp_path)).collect()
    assert fitted == [80]
