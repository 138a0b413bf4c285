import os

import pytest

import __spark_entry__ as contract
from compare import connect, duck_result, spark_result
from tidemark.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    found = spark_result(contract.queries()[name](spark, SF))
    wanted = duck_result(duck, ORACLE[name])
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1])
    assert found[1] == wanted[1]
    assert found[1], "a query without rows proves nothing"


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(ORACLE)))
def test_runs(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sixths_hold_every_row_once_and_are_cut_without_listing_all_ids(spark, tmp_path, monkeypatch):
    def listed(*_):
        raise AssertionError("one task would hold every id")

    monkeypatch.setattr(catalog.F, "percentile", listed)
    sf, out = "/root/testdata/sf0.001", str(tmp_path / "in")
    sizes = [spark.read.schema("event_id long").parquet(out).count() for _ in catalog._sixths(spark, sf, out)]
    rows = catalog.events(spark, sf).filter("event_id is not null")
    assert len(sizes) == 6 and max(b - a for a, b in zip([0, *sizes], sizes)) <= rows.count() / 6 + 2
    found = spark.read.parquet(out)
    assert found.exceptAll(rows).isEmpty() and rows.exceptAll(found).isEmpty()
