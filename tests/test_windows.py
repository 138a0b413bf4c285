import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift

T0 = datetime(2020, 2, 27)
EPOCH = datetime(1970, 1, 1)
HOUR = 3600


def rows(seed, n, shift=0.0):
    draw = random.Random(seed)
    return [
        (draw.choice([None, draw.gauss(shift, 1), draw.gauss(shift, 3)]), draw.choice([None, float(draw.randint(0, 3)), math.nan]), T0 + timedelta(minutes=draw.randint(0, 20_000)))
        for _ in range(n)
    ]


KIND = "x double, y double, at timestamp_ntz"


def share(counts, total):
    return [c / max(total, 1) + 1e-6 for c in counts]


def expected(base, current, edges, column, size, slide):
    i = "xy".index(column)

    def place(v):
        if v is None or math.isnan(v):
            return None
        if not edges[0] <= v <= edges[-1]:
            return -1
        return min(sum(e <= v for e in edges), len(edges) - 1) - 1

    def bins(values):
        found = Counter(place(v) for v in values)
        inside = [found[b] for b in range(len(edges) - 1)]
        return inside, sum(found[b] for b in found if b is not None)

    b, _ = bins(r[i] for r in base)
    out = {}
    starts = set()
    for r in current:
        if any(v is not None and not math.isnan(v) for v in r[:2]):
            t = (r[2] - EPOCH).total_seconds()
            first = math.floor((t - size) / slide) * slide + slide
            starts |= set(range(int(first), int(t) + 1, slide)) if first <= t else set()
    for s in starts:
        held = [r[i] for r in current if s <= (r[2] - EPOCH).total_seconds() < s + size]
        c, n = bins(held)
        pairs = list(zip(share(b, sum(b)), share(c, sum(c))))
        out[EPOCH + timedelta(seconds=s)] = sum((q - p) * math.log(q / p) for p, q in pairs) if n else 0.0
    return out


@pytest.mark.parametrize(("size", "slide"), [(24, 24), (72, 24), (60, 24), (24, 60), (5, 3)])
def test_every_window_against_its_own_rows(spark, size, slide):
    base, current = rows(1, 400), rows(2, 300, 0.7)
    frames = [spark.createDataFrame(r, KIND) for r in (base, current)]
    edges = drift.fit_edges(frames[0], ["x", "y"], 6)
    found = drift.sliding_psi(*frames, ["x", "y"], "at", size * HOUR, slide * HOUR, edges=edges).collect()
    for column in "xy":
        got = {r.window_start: r for r in found if r.feature == column}
        wanted = expected(base, current, edges[column].edges, column, size * HOUR, slide * HOUR)
        assert got.keys() == wanted.keys()
        for start, value in wanted.items():
            assert got[start].statistic == pytest.approx(value, abs=1e-9)
            assert got[start].window_end == start + timedelta(hours=size)
            assert got[start].drifted == (got[start].statistic >= 0.25)


def test_kept_panes_merge_in_any_cut(spark):
    base, current = rows(3, 300), rows(4, 300, 0.4)
    whole = spark.createDataFrame(current, KIND)
    frame = spark.createDataFrame(base, KIND)
    edges = drift.fit_edges(frame, ["x"], 5)
    size, slide = 48 * HOUR, 12 * HOUR
    width = drift.pane_width(size, slide)
    cut = [whole.filter(F.pmod(F.xxhash64("x", "at"), F.lit(3)) == i) for i in range(3)]
    kept = drift.merge_panes(*[drift.pane_histograms(c, edges, "at", width) for c in cut[:2]])
    args = (["x"], "at", size, slide)
    a = drift.sliding_psi(frame, whole, *args, edges=edges).orderBy("window_start").collect()
    b = drift.sliding_psi(frame, cut[2], *args, edges=edges, panes=kept).orderBy("window_start").collect()
    assert [r.window_start for r in a] == [r.window_start for r in b]
    assert [r.statistic for r in a] == pytest.approx([r.statistic for r in b], abs=1e-12)


def test_panes_hold_each_value_once(spark):
    current = spark.createDataFrame(rows(5, 200), KIND)
    edges = drift.fit_edges(current, ["x"], 4)
    panes = drift.pane_histograms(current, edges, "at", 6 * HOUR)
    assert panes.agg(F.sum("current")).first()[0] == current.filter("x is not null").count()
    windows = drift.window_counts(panes, 24 * HOUR, 6 * HOUR)
    assert windows.agg(F.sum("current")).first()[0] == 4 * current.filter("x is not null").count()


def test_empty_sides_and_bad_windows(spark):
    base, nothing = spark.createDataFrame(rows(6, 50), KIND), spark.createDataFrame([], KIND)
    assert drift.sliding_psi(base, nothing, ["x"], "at", HOUR, HOUR).collect() == []
    with pytest.raises(ValueError, match="no baseline"):
        drift.sliding_psi(nothing, base, ["x"], "at", HOUR, HOUR)
    with pytest.raises(ValueError, match="some seconds"):
        drift.pane_width(0, 5)
