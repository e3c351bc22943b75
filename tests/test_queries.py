"""Every registered query of the surveillance library against its SQL."""

import pytest
from compare import differences, duck

from tidewatch.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    if name in SQL:
        assert differences(spark, connection, QUERIES[name], SQL[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0  # what they rest on is tested in test_operators.py
