"""Every query with SQL: the same rows and values from both engines."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tidegauge.catalog.all import ORACLES, QUERIES



@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(name, spark, data, con):
    found = differences(entry.queries()[name](spark, data), con, ORACLES[name])
    assert not found, "\n".join(found)


def test_every_query_without_sql_is_a_model():
    rest = set(QUERIES) - set(ORACLES)
    assert all(n.startswith("ml_") or n == "top_importances" for n in rest), rest


def test_flagship_counts(spark, data):
    rows = {(r["tier"], r["target"]): r for r in entry.queries()[entry.FLAGSHIP](spark, data).collect()}
    assert rows["tier1_all", "direction"]["n"] == 131
    assert round(rows["tier1_all", "direction"]["accuracy"], 4) == 0.5420
    assert round(rows["tier2_non_confounded", "direction"]["accuracy"], 4) == 0.5104
    assert round(rows["tier3_active", "direction"]["accuracy"], 4) == 0.0244
