"""Every query of the general catalogue that has an oracle equals it on the smallest tables."""

import importlib

import pytest

from cinderloom.plans import MODULES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
CASES = {n: (m.QUERIES[n], m.SQL[n]) for m in (importlib.import_module(f"cinderloom.plans.{x}") for x in MODULES) for n in m.SQL}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CASES))
def test_equal(spark, con, name):
    assert compare(spark, con, SF, *CASES[name]) == ""
