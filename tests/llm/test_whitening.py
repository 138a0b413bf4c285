import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening as wh
from tidemark.llm.queries import op12_whitening

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, components=32, weigh=True):
    """{vec_id: [(n, deviation)]}, eigenvalue shares and whitened vectors, by numpy and integers."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in good)
    width = max(sizes, key=lambda k: (sizes[k], k))
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good if len(v) == width]
    fit = [x for _, x in good] if weigh else [list(x) for x in {tuple(x) for _, x in good}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in good]
    centre = np.array(sums, float) / n
    c = np.array(fit, float) - centre
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > 1e-12 * values.max()]
    white = [(i, (np.array(x, float) - centre) @ vectors[:, order] / np.sqrt(values[order])) for i, x in good]
    return n, deviation, values[order] / values.sum(), white


def check(found, rows, components=32, weigh=True):
    n, deviation, shares, white = plain(rows, components, weigh)
    by = defaultdict(list)
    for r in found:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, len(shares) + 1))
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and 0 <= errors.pop() <= 1e-4
    for k, got in by.items():
        assert Counter((r.vec_id, r.n, r.deviation) for r in got) == Counter((i, n, d) for i, d in deviation)
        assert all(abs(r.explained - shares[k - 1]) <= 1e-9 for r in got)
        wanted = sorted(((i, float(v[k - 1])) for i, v in white), key=str)
        have = [(r.vec_id, r.whitened) for r in got]
        near = [
            np.allclose(sorted(s * x for _, x in have), sorted(x for _, x in wanted), atol=1e-6) for s in (1, -1)
        ]
        assert any(near), k


def vectors(seed=2, n=300, width=40):
    draw = np.random.default_rng(seed)
    base = (draw.standard_normal((n, width)) * np.linspace(2, 0.2, width)).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[3]) for i in range(200)] + [(2000 + i, base[i]) for i in range(20)]
    bad = [(None, base[5]), (1, base[6]), (3000, None), (3001, []), (3002, [1.0] * (width - 1)), (3003, [1.0] * (width + 5))]
    bad += [(3004, [None] + base[1][1:]), (3005, [float("nan")] + base[1][1:]), (3006, [float("inf")] + base[1][1:])]
    return rows + bad


def frame(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND).repartition(6)
    return df.select("*", *(F.lit(1).alias(c) for c in ("x", "n", "component", "whitened", "deviation", "at", "v")))


@pytest.mark.parametrize("weigh", [True, False])
def test_awkward_vectors_against_numpy(spark, weigh):
    rows = vectors()
    check(wh.whiten(frame(spark, rows), weigh=weigh).collect(), rows, weigh=weigh)


def test_frequent_vectors_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(wh, "HOT_LEAST", 50)
    rows = vectors(seed=5)
    check(wh.whiten(frame(spark, rows), components=7).collect(), rows, components=7)


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_whitening(spark, sf).collect(), rows)


def test_equal_vectors_have_one_whitened_vector(spark):
    found = wh.whiten(frame(spark, vectors())).where("vec_id = 3 OR vec_id BETWEEN 1000 AND 1199").collect()
    for k in range(1, 33):
        assert len({r.whitened for r in found if r.component == k}) == 1


def test_directions_without_variance_are_left_out(spark):
    draw = random.Random(1)
    flat = [(i, [draw.random(), draw.random(), 0.5, 0.25]) for i in range(50)]
    found = wh.whiten(frame(spark, flat)).collect()
    assert {r.component for r in found} == {1, 2} and len(found) == 100
    check(found, flat)


def test_tables_without_directions(spark):
    assert wh.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert wh.whiten(spark.createDataFrame([], KIND)).collect() == []
    assert wh.whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [5.0, 1e9]), (4, [0.0, 0.0])]
    found = {(r.vec_id, r.component): r for r in wh.whiten(frame(spark, rows)).collect()}
    assert {k[0] for k in found} == {1, 2, 3, 4}
    # Such a deviation is beyond a long.
    assert found[1, 1].deviation is None and math.isfinite(found[1, 1].whitened)


def test_sums_are_exact(spark):
    x = [[(1 << 61) + 3, -7], [(1 << 61) + 5, 11]]
    parts = spark.createDataFrame([(np.array(v, "<i8").tobytes(), k) for v, k in zip(x, (3_000_000, 5_000_000))], "x binary, n long")
    assert wh._exact_sums(parts, 2, True) == (8_000_000, [3_000_000 * x[0][0] + 5_000_000 * x[1][0], -21_000_000 + 55_000_000])
    parts = parts.withColumn("n", F.lit(1 << 40).cast("long"))
    assert wh._exact_sums(parts, 2, True) == (2 << 40, [(x[0][0] + x[1][0]) << 40, 4 << 40])
