"""Every registered query of the library against its SQL, or at least run."""

import pytest

from mnemora.plans import catalog
from mnemora.session import reachable
from tests.compare import SF_DIR, both


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, name):
    reachable(spark)
    got, want = both(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    reachable(spark)
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
