import pytest

import __spark_entry__ as entry
from aerolytics import queries as flights

from oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(flights.ORACLE))
def test_query_equals_oracle(spark, con, name):
    compare(con, flights.QUERIES[name](spark, SF), flights.ORACLE[name])


def test_every_query_but_the_iterated_fit_has_an_oracle():
    assert set(flights.QUERIES) - set(flights.ORACLE) == {"q31_fits"}


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_fits_run(spark):
    row = flights.QUERIES["q31_fits"](spark, SF).first()
    assert row["alpha"] > 1 and 0 <= row["p"] <= 1
