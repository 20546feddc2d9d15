"""Every catalogue query against its SQL twin."""

import os

import pytest
from same import duck_rows, spark_rows

from lumenframe import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    cols, rows = spark_rows(catalogue.queries()[name](spark, SF))
    if name in catalogue.oracle_sql():
        assert (cols, rows) == duck_rows(catalogue.oracle_sql()[name], SF)
    else:
        assert cols and rows


def test_every_query_names_operators():
    assert set(catalogue.operators()) == set(catalogue.queries())
