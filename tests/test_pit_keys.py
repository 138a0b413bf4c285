import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureGroup
from tidemark.operators.pit import Keyed, plan_passes, point_in_time_join_keys
from tidemark.plans.training import training_set_keys
from tidemark.sources import offline

T0 = datetime(2021, 6, 1)
SHOP = FeatureGroup("shop", "shop_id", (Feature("rank", "int64"),), entity_dtype="int64")
DEVICE = FeatureGroup("device", "device", (Feature("load", "float64"), Feature("os", "string")), entity_dtype="string")
AREA = FeatureGroup("area", "area_id", (Feature("heat", "float_list"),), entity_dtype="int64")


def minutes(n):
    return T0 + timedelta(minutes=n)


def data(seed):
    draw = random.Random(seed)
    shops = [(draw.randrange(6), minutes(draw.randrange(500)), i, i) for i in range(80)]
    devices = [(f"d{draw.randrange(5)}", minutes(draw.randrange(500)), draw.random(), draw.choice(["x", None]), i) for i in range(70)]
    spine = []
    for _ in range(120):
        shop, device = draw.choice([None, 99, *range(6)]), draw.choice([None, *(f"d{i}" for i in range(6))])
        spine.append((draw.choice("abc"), shop, device, draw.choice([None, minutes(draw.randrange(520))])))
    return shops, devices, spine + spine[:7]


def frames(spark, seed):
    shops, devices, spine = data(seed)
    return (
        spark.createDataFrame(shops, "shop_id long, _event_ts timestamp_ntz, rank long, _ingest_ts long"),
        spark.createDataFrame(devices, "device string, _event_ts timestamp_ntz, load double, os string, _ingest_ts long"),
        spark.createDataFrame(spine, "label string, shop long, dev string, event_ts timestamp_ntz"),
    )


def newest(rows, key, at):
    if key is None or at is None:
        return None
    return max((r for r in rows if r[0] == key and r[1] <= at), key=lambda r: (r[1], r[-1]), default=None)


def expected(seed):
    shops, devices, spine = data(seed)
    out = Counter()
    for label, shop, dev, at in spine:
        s, d = newest(shops, shop, at), newest(devices, dev, at)
        out[(label, shop, dev, at, *((s[2], s[1]) if s else (None, None)), *((d[2], d[3], d[1]) if d else (None, None, None)))] += 1
    return out


@pytest.mark.parametrize("hot_rows", [None, 10])
@pytest.mark.parametrize("seed", [1, 2])
def test_each_group_by_its_own_key(spark, seed, hot_rows):
    shops, devices, spine = frames(spark, seed)
    groups = [Keyed("shop", SHOP, shops), Keyed("dev", DEVICE, devices)]
    found = point_in_time_join_keys(spine, groups, hot_rows=hot_rows)
    assert found.columns == ["label", "shop", "dev", "event_ts", "rank", "_ts_shop", "load", "os", "_ts_device"]
    assert Counter(map(tuple, found.collect())) == expected(seed)
    # The order of the groups decides the columns only.
    turned = point_in_time_join_keys(spine, groups[::-1], hot_rows=hot_rows)
    assert turned.columns[4:] == ["load", "os", "_ts_device", "rank", "_ts_shop"]
    assert Counter(map(tuple, turned.select(found.columns).collect())) == expected(seed)


def test_one_shuffle_for_each_key(spark):
    shops, devices, spine = frames(spark, 3)
    groups = [Keyed("shop", SHOP, shops), Keyed("dev", DEVICE, devices)]
    groups.append(Keyed("dev", FeatureGroup("more", "device", (Feature("extra", "float64"),)), devices.withColumnRenamed("load", "extra")))
    plan = point_in_time_join_keys(spine, groups, hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_wide_groups_come_last():
    groups = [Keyed("area", AREA, None), Keyed("dev", DEVICE, None), Keyed("shop", SHOP, None), Keyed("area", SHOP, None)]
    assert [key for key, _ in plan_passes(groups)] == ["shop", "dev", "area"]
    assert [g.fg.name for g in dict(plan_passes(groups))["area"]] == ["area", "shop"]


def test_clashing_names_are_an_error_before_anything_runs(spark):
    shops, devices, spine = frames(spark, 4)
    other = FeatureGroup("other", "device", (Feature("rank", "float64"),))
    groups = [Keyed("shop", SHOP, shops), Keyed("dev", other, devices.withColumnRenamed("load", "rank"))]
    with pytest.raises(ValueError, match="appears twice"):
        point_in_time_join_keys(spine, groups)
    found = point_in_time_join_keys(spine, groups, prefix=True)
    assert {"shop__rank", "other__rank"} <= set(found.columns)


def test_stored_groups_and_a_group_without_data(spark, tmp_path):
    shops, devices, spine = frames(spark, 5)
    root = str(tmp_path)
    offline.write_features(SHOP, shops, root)
    offline.write_features(DEVICE, devices, root)
    found = training_set_keys(spark, spine, {"shop": [SHOP, AREA], "dev": [DEVICE]}, root)
    assert {r.heat for r in found.select("heat").collect()} == {None}
    columns = ["label", "shop", "dev", "event_ts", "rank", "_ts_shop", "load", "os", "_ts_device"]
    assert Counter(map(tuple, found.select(columns).collect())) == expected(5)
    assert found.filter(F.col("_ts_area").isNotNull()).count() == 0
