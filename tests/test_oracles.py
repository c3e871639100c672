"""Registered queries against their SQL at sf0.001."""

import pytest

from oracle_check import compare, duck
from pressmill.plans import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    status, rows, _, info = compare(spark, con, name, registry.QUERIES[name], registry.ORACLES.get(name), SF_DIR)
    assert status in ("ok", "rows-only"), info
