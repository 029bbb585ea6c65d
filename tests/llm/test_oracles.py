"""Queries of the package against their SQL."""
import pytest
from compare import differences, duck

from thawline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    message, rows = differences(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert rows and not message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
