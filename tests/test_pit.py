import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureGroup
from tidemark.operators import pit
from tidemark.operators.pit import point_in_time_join
from tidemark.plans.training import training_set
from tidemark.sources.offline import write_features

T0 = datetime(2024, 1, 1)
SPINE = "row int, user string, event_ts timestamp_ntz"
FEATURES = "user string, _event_ts timestamp_ntz, a long, b string, _ingest_ts long"
A = FeatureGroup("grp", "user", (Feature("a", "int64"), Feature("b", "string")))


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def expected(spine, features):
    out = {}
    for row, user, ts in spine:
        best = None
        for f in features:
            if user is None or ts is None or f[0] != user or f[1] is None or f[1] > ts:
                continue
            if best is None or (f[1], f[4]) >= (best[1], best[4]):
                best = f
        out[row] = (best[2], best[3], best[1]) if best else (None, None, None)
    return out


def run(spark, spine, features, **options):
    s = spark.createDataFrame(spine, SPINE)
    f = spark.createDataFrame(features, FEATURES)
    rows = point_in_time_join(s, [(A, f)], "user", **options).collect()
    assert len(rows) == len(spine)
    return {r.row: (r.a, r.b, r._ts_grp) for r in rows}


def random_case(seed, users, span, n_spine, n_features):
    rng = random.Random(seed)

    def user():
        # One user holds a third of the rows.
        return rng.choice(["hot", rng.choice(users), rng.choice(users), None][: 3 + (rng.random() < 0.1)])

    def ts():
        return None if rng.random() < 0.05 else at(rng.randrange(span))

    spine = [(i, user(), ts()) for i in range(n_spine)]
    features = [
        (user(), ts(), rng.choice([None, rng.randrange(9)]), rng.choice("xyz"), i)
        for i in range(n_features)
    ]
    return spine, features


@pytest.mark.parametrize("hot_rows", [4_000_000, None, 30, 4])
@pytest.mark.parametrize("seed,span", [(1, 300), (2, 12)])
def test_random_against_brute_force(spark, seed, span, hot_rows):
    spine, features = random_case(seed, ["u1", "u2", "u3", "u4"], span, 150, 120)
    found = run(spark, spine, features, hot_rows=hot_rows)
    assert found == expected(spine, features)


def test_hot_instant(spark):
    """Most rows share one entity and one instant, among them exact copies."""
    spine = [(i, "hot", at(60)) for i in range(40)] + [(100, "hot", at(59)), (101, "hot", at(61))]
    features = [("hot", at(60), i, "x", i) for i in range(30)]
    features += [("hot", at(10), 77, "y", 1000), ("hot", at(200), 78, "y", 1001)]
    found = run(spark, spine, features, hot_rows=5)
    assert found == expected(spine, features)
    assert found[0][0] == 29 and found[100][0] == 77 and found[101][0] == 29


def test_boundaries(spark):
    features = [("u", at(5), 1, "x", 0), ("u", at(5), 2, "y", 1), ("v", at(1), None, None, 0)]
    spine = [(0, "u", at(5)), (1, "u", at(4)), (2, "v", at(9)), (3, "w", at(9))]
    found = run(spark, spine, features)
    assert found[0] == (2, "y", at(5))  # inclusive, the later arrival wins
    assert found[1] == (None, None, None)  # label before any feature
    assert found[2] == (None, None, at(1))  # null features still are a match
    assert found[3] == (None, None, None)


def test_never_sees_the_future(spark):
    spine, features = random_case(5, ["a", "b"], 100, 80, 80)
    s, f = spark.createDataFrame(spine, SPINE), spark.createDataFrame(features, FEATURES)
    joined = point_in_time_join(s, [(A, f)], "user", hot_rows=6)
    assert joined.filter(F.col("_ts_grp") > F.col("event_ts")).count() == 0


def test_many_groups_missing_data_and_prefix(spark):
    spine, features = random_case(7, ["a", "b"], 50, 20, 40)
    s, f = spark.createDataFrame(spine, SPINE), spark.createDataFrame(features, FEATURES)
    groups = [
        (FeatureGroup(f"g{i}", "user", A.features), None if i == 3 else f)
        for i in range(pit.GROUPS_PER_PASS + 2)
    ]
    joined = point_in_time_join(s, groups, "user", prefix=True)
    want = expected(spine, features)
    rows = joined.collect()
    assert len(rows) == len(spine)
    for r in rows:
        for i in range(len(groups)):
            got = (r[f"g{i}__a"], r[f"g{i}__b"], r[f"_ts_g{i}"])
            assert got == ((None, None, None) if i == 3 else want[r.row])


def test_name_clash_and_type_mismatch(spark):
    s = spark.createDataFrame([(1, "u", at(1))], "a int, user string, event_ts timestamp_ntz")
    f = spark.createDataFrame([("u", at(1), 1, "x", 0)], FEATURES)
    with pytest.raises(ValueError, match="twice"):
        point_in_time_join(s, [(A, f)], "user")
    assert point_in_time_join(s, [(A, f)], "user", prefix=True).first().grp__a == 1
    wrong = s.withColumn("user", F.lit(5))
    with pytest.raises(TypeError):
        point_in_time_join(wrong, [(A, f)], "user", prefix=True)


def test_zoned_times_and_other_entity_name(spark):
    s = spark.createDataFrame([(1, "u")], "row int, who string").withColumn(
        "label_ts", F.timestamp_seconds(F.lit(1_700_000_000))
    )
    f = spark.createDataFrame([("u", 1_700_000_000.0, 4, "x")], "user string, _event_ts double, a long, b string")
    row = point_in_time_join(s, [(A, f)], "who", "label_ts").first()
    assert row.a == 4 and row._ts_grp == datetime(2023, 11, 14, 22, 13, 20)


def test_one_shuffle_for_all_groups(spark):
    s = spark.createDataFrame([(1, "u", at(1))], SPINE)
    f = spark.createDataFrame([("u", at(1), 1, "x", 0)], FEATURES)
    groups = [(FeatureGroup(f"g{i}", "user", A.features), f) for i in range(3)]
    joined = point_in_time_join(s, groups, "user", prefix=True, hot_rows=None)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_training_set_prunes_dates(spark, tmp_path):
    f = spark.createDataFrame(
        [("u", at(0), 1, "x", 0), ("u", at(60 * 24 * 9), 2, "y", 1)], FEATURES
    )
    write_features(A, f, str(tmp_path))
    s = spark.createDataFrame([(1, "u", at(60 * 24))], SPINE)
    joined = training_set(spark, s, [A, FeatureGroup("never_written", "user", (Feature("z", "bool"),))], str(tmp_path), "user")
    row = joined.first()
    assert (row.a, row.z, row._ts_never_written) == (1, None, None)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan


def test_chunks_of_a_large_cell_stay_near_the_bound(spark):
    # A million rows of one entity in one hour, unevenly over it; a tenth at one instant.
    at = F.timestamp_add("MICROSECOND", F.pmod(F.col("id") * F.col("id"), F.lit(3_599_999_999)), F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))
    one = F.lit("2024-05-01 10:20:00").cast("timestamp_ntz")
    rows = spark.range(1_000_000).select(F.lit(1).alias("__k"), F.when(F.col("id") % 10 == 0, one).otherwise(at).alias("__t"))
    chunks = pit._chunked(rows, 1_000, F.broadcast).groupBy("__chunk", "__point").agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("a"), F.max("__t").alias("z"))
    found = chunks.orderBy("a", "z").collect()
    assert max(r.n for r in found if not r["__point"]) < 2_000
    assert [r.n for r in found if r["__point"]] == [100_000]
    # Chunks follow time.
    assert [r["__chunk"] for r in found] == sorted(r["__chunk"] for r in found)
