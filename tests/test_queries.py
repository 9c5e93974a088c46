"""Every registered query against its SQL, over whole tables."""

import compare
import pytest

from pagetone.plans.oracle import ORACLE
from pagetone.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    wrong, n, only_spark, only_sql = compare.differences(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    assert not wrong and not only_spark and not only_sql
    assert n > 0
