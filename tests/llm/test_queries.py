"""The registered queries of the subpackage against their SQL."""

import pytest

from mnemora.llm import queries
from mnemora.session import reachable
from tests.compare import both


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    reachable(spark)
    got, want = both(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert got == want


def test_all_are_there():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
