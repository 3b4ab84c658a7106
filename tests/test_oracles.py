"""All registered queries with a SQL twin against it on the smallest tables (skipped where those are absent)."""

import os

import pytest

from checks import verify
from checks.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, con, name):
    result = verify.compare(spark, con, SF_DIR, name)
    assert result.startswith("ok"), result


def test_every_twin_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
