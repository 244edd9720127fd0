"""Every query against its SQL, or for rows where SQL can't say it."""

import pytest

from brontide.queries import oracle_sql, queries
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    if name in oracle_sql():
        same_rows(df, duck, oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
