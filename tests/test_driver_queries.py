"""Every registered query of the spending library against its SQL, or at least run, on the smallest tables."""

import os

import pytest

from tallyspark.plans import evidence_queries, spending_queries, storage_queries  # noqa: F401  they register their queries
from tallyspark.plans.driver_tables import ORACLE_SQL, QUERIES
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="the provided tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        oracle.assert_same(spark, QUERIES[name], ORACLE_SQL[name])
    else:
        assert QUERIES[name](spark, oracle.FOLDER).count() > 0
