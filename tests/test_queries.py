"""Every registered query at the smallest scale: against its SQL, or at least with rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from emberlog.plans import catalog
from tests.compare import connect, differences

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE
# at this scale no window of 512 logs fills
EMPTY = {"E3_count_windows"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        problem = differences(df, con, ORACLE[name])
        assert problem is None or (problem == "both sides are empty" and name in EMPTY), problem
    else:
        assert df.limit(1).count() == 1


def test_entry(spark):
    feed = entry_module.entry(spark)
    assert feed.columns[:4] == ["type", "id", "hash", "service"]
    ends = [r.end_us for r in feed.collect()]
    assert ends == sorted(ends, reverse=True) and ends
