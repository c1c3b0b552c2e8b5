"""Registered queries of the llm operators that SQL can express, on the smallest tables."""

import os

import pytest

from tallyspark.llm.registry import ORACLE_SQL, QUERIES
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="the provided tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    oracle.assert_same(spark, QUERIES[name], ORACLE_SQL[name])
