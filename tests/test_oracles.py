"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from millwatch.plans.oracles import SQL
from millwatch.plans.queries import all_queries
from tests.compare import difference, duck
from tests.conftest import DATA

QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got) > 0 or name == "calibration_clear"
    assert difference(got, con.execute(SQL[name]).df()) is None


def test_entry_runs(spark):
    assert entry.entry(spark).columns == [
        "equipment_id", "model_version", "tick", "anomaly_score", "top_deviant_tag", "alarm",
    ]
