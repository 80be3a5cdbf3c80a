"""Every core query with SQL gives the SQL's rows at the smallest scale."""
import os

import pytest
from oracle import compare, duck

from quernstone.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    assert compare(spark, db, QUERIES[name], ORACLES[name], SF) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
