"""Every query with SQL against that SQL."""

import pytest

from strandlog import plans
from tests.oracle import assert_same

@pytest.mark.parametrize("name", plans.oracle_sql())
def test_query_equals_its_sql(spark, data, name):
    assert_same(spark, plans.queries()[name], plans.oracle_sql()[name], data)


def test_every_name_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


def test_entry_point_works_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_label_never_reaches_the_search(spark, data):
    from strandlog.plans.views import Views

    assert "label" not in Views(spark, data).edges.columns
