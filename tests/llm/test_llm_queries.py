"""The opN queries equal their SQL on the smallest tables, and give a row a row without one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import assert_same, connect  # noqa: E402

from lodestone.llm import queries as Q  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, tiny, name):
    assert_same(Q.queries()[name](spark, tiny), Q.oracle_sql()[name], connect(tiny))


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_a_row_each(spark, tiny, name):
    rows, table = Q.queries()[name](spark, tiny), "pages" if name.startswith("op2") else "documents"
    assert rows.count() == spark.read.parquet(f"{tiny}/{table}.parquet").count()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))
