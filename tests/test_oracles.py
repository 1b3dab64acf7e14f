"""Every registered query next to its SQL, as the driver compares them."""

import pytest

import check_oracle
from loadscope.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(sf_dir):
    return check_oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, sf_dir, name):
    problem, _, _ = check_oracle.compare(spark, tables, sf_dir, name)
    assert problem is None


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
