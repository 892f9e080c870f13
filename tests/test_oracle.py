"""Every registered query against its SQL, on the smallest tables."""

import re

import pytest

from locusloom.plans import catalog
from locusloom.plans.check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], sf_dir) is None


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    without_sql = set(catalog.QUERIES) - set(entry.oracle_sql())
    assert without_sql == {"ancestry_components"}


def test_no_row_is_taken_by_number():
    """No query shrinks its tables by row caps other than the features that are one."""
    for name, sql in catalog.ORACLE.items():
        if name not in ("preview", "region_page"):
            assert not re.search(r"\bLIMIT\b", sql), name
