"""The operators' queries next to their SQL, and their columns."""

import check_oracle
import pytest

from loadscope.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(check_oracle, "QUERIES", QUERIES)
    monkeypatch.setattr(check_oracle, "ORACLES", ORACLES)
    problem, _, _ = check_oracle.compare(spark, check_oracle.connect(sf_dir), sf_dir, name)
    assert problem is None


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] and {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
