"""Every registered query against its SQL twin; queries without one must give rows."""

import pytest
from compare import SF_DIR, diff, duck

from tidemark.plans import registry

MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    if name in registry.ORACLES:
        msg, _ = diff(df, registry.ORACLES[name], con)
        assert msg is None, msg
    else:
        n = df.count()
        assert n == 0 if name in MAY_BE_EMPTY else n > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
