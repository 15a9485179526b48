"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import pytest

import __spark_entry__ as driver
from checks import ORACLE, QUERIES
from checks.compare import compare, connect
from checks.coverage import TESTED, by_row

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    rows, same, note = compare(spark, tables, SF, QUERIES[name], ORACLE.get(name))
    assert same is not False, note
    if name in ORACLE:
        return
    assert rows > 0


def test_entry_is_lazy_and_has_columns(spark):
    df = driver.entry(spark)
    assert "response" in df.columns
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_every_survey_row_is_covered():
    """Rows of the survey's inventory that a query or a test covers."""
    wanted = {f"{letter}{n}" for letter, last in
              (("A", 14), ("B", 12), ("C", 15), ("D", 30), ("E", 9), ("F", 7), ("G", 3), ("T", 17), ("H", 40), ("S", 6), ("U", 4))
              for n in range(1, last + 1)}
    assert wanted - set(by_row()) - set(TESTED) == set()
