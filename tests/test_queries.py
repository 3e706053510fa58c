"""Every query with SQL equals it on the smallest tables; every other runs and keeps its schema."""

import pytest

from lodestone.plans import documents, relational, reports, statements, storage
from oracle import assert_same, connect

ALL = {name: (f, sql) for m in (documents, relational, reports, statements, storage) for name, f in m.queries().items() for sql in [m.oracle_sql().get(name)]}


@pytest.fixture(scope="module")
def db(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, tiny, db, name):
    f, sql = ALL[name]
    if sql:
        assert_same(f(spark, tiny), sql, db)
    else:
        rows = f(spark, tiny)
        assert rows.columns and len(set(rows.columns)) == len(rows.columns)
        rows.write.format("noop").mode("overwrite").save()


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
