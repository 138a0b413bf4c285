from datetime import datetime

import pytest
from pyspark.sql import Observation

from tidemark import Feature, FeatureGroup
from tidemark.sources import offline

T1, T2 = datetime(2024, 1, 1, 5), datetime(2024, 1, 2, 6)
V1 = FeatureGroup("act", "uid", (Feature("a", "int64"),), entity_dtype="int64")
V1_MORE = FeatureGroup("act", "uid", (Feature("a", "int64"), Feature("b", "string")), entity_dtype="int64")
SCHEMA = "uid long, _event_ts timestamp_ntz, a long"


def test_missing_and_wrong_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "other long, a string")
    with pytest.raises(ValueError, match=r"\['_event_ts', 'uid'\]"):
        offline.write_features(V1, df, str(tmp_path))
    wrong = spark.createDataFrame([(1, T1, "x")], "uid long, _event_ts timestamp_ntz, a string")
    with pytest.raises(ValueError, match="act.a"):
        offline.write_features(V1, wrong, str(tmp_path))


def test_layout_null_times_and_replay(spark, tmp_path):
    df = spark.createDataFrame([(1, T1, 1), (2, T2, 2), (3, None, 3)], SCHEMA)
    for _ in range(2):
        path = offline.write_features(V1, df, str(tmp_path), batch="b1")
    assert path.endswith("/act_v1")
    seen = Observation()
    offline.write_features(V1, df, str(tmp_path), batch="b1", observation=seen)
    assert seen.get == {"rows": 2, "dropped": 1}
    assert sorted(p.name for p in (tmp_path / "act_v1/batch=b1").iterdir() if p.is_dir()) == [
        "date=2024-01-01",
        "date=2024-01-02",
    ]
    assert any(p.suffixes[-2:] == [".zstd", ".parquet"] for p in (tmp_path / "act_v1").rglob("*.parquet"))
    assert offline.read_features(spark, V1, str(tmp_path)).count() == 2
    offline.write_features(V1, df, str(tmp_path))  # another batch appends
    assert offline.read_features(spark, V1, str(tmp_path)).count() == 4
    assert offline.dedup_features(offline.read_features(spark, V1, str(tmp_path))).count() == 2
    assert offline.read_features(spark, V1, str(tmp_path), until="2024-01-01").count() == 2


def test_evolution_and_versions(spark, tmp_path):
    root = str(tmp_path)
    old = spark.createDataFrame([(1, T1, 1)], SCHEMA)
    new = spark.createDataFrame([(2, T2, 2, "x")], SCHEMA + ", b string")
    offline.write_features(V1, old, root)
    offline.write_features(V1_MORE, new, root)
    rows = {r.uid: r.b for r in offline.read_features(spark, V1_MORE, root).collect()}
    assert rows == {1: None, 2: "x"}
    stored = spark.read.parquet(offline.table_path(V1, root)).schema
    assert offline.check_evolution(old.schema, V1_MORE)["added"] == ["b"]
    with pytest.raises(ValueError, match="new version"):
        offline.check_evolution(new.schema, V1)
    assert "a" in stored.fieldNames()
    v2 = FeatureGroup("act", "uid", V1.features, version=2, entity_dtype="int64")
    assert offline.read_features(spark, v2, root).count() == 0
    assert offline.read_features(spark, v2, root).columns == ["uid", "_event_ts", "a", "_ingest_ts"]


def test_spec_rules_and_json():
    assert FeatureGroup.from_json(V1_MORE.to_json()) == V1_MORE
    for bad in ("Upper", "1x", "", "x" * 64, "x-y"):
        with pytest.raises(ValueError):
            Feature(bad, "int64")
        with pytest.raises(ValueError):
            FeatureGroup(bad, "Any Entity", ())
    with pytest.raises(ValueError):
        Feature("ok", "decimal")
    with pytest.raises(ValueError, match="repeats"):
        FeatureGroup("g", "e", (Feature("a", "int64"), Feature("a", "bool")))
