"""Every query against its SQL, and the shape of its plan."""

import os

import pytest

from checks import ALL_ORACLES, ALL_QUERIES
from checks.compare import difference, duck_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas"]
# Bodies nested deeper than the expressions reach are all that goes to Python.
ALLOWED_PYTHON = ("nested_text(", "nested_names(")


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_DIR)


def test_each_query_has_its_sql():
    assert set(ALL_ORACLES) == set(ALL_QUERIES)


@pytest.mark.parametrize("name", list(ALL_QUERIES))
def test_query(spark, duck, name):
    frame = ALL_QUERIES[name](spark, SF_DIR)
    rows = [tuple(row) for row in frame.collect()]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in UNWANTED if operator in plan]
    python = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert all(any(name in line for name in ALLOWED_PYTHON) for line in python)
    result = duck.execute(ALL_ORACLES[name])
    columns = [item[0] for item in result.description]
    expected = result.fetchall()
    assert expected, "the check would compare nothing"
    assert difference(rows, frame.columns, expected, columns) is None
