"""Every registered query against its SQL, or against the promise of rows."""
import os

import pytest

from compare import differences, duck
from thawline.plans.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("THAWLINE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    message, _ = differences(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert not message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns and df.collect() is not None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
