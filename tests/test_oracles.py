"""Every core query: against its SQL where it has one, else that it gives rows."""

import pytest
from compare import difference

from lapidar.plans import catalog

MAY_BE_EMPTY = {"report_strict_mismatch", "append_absent", "unprocessed_docs"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, small, name):
    said = difference(spark, catalog.QUERIES[name], catalog.ORACLES[name], small)
    assert not said or said == "no rows" and name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
