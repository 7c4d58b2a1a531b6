"""Every query against its DuckDB SQL on the smallest tables."""

import oracle
import pytest

from lumiform import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    rows = oracle.spark_rows(catalogue.QUERIES[name](spark, sf))
    if name in catalogue.ORACLE:
        assert rows == oracle.duck_rows(duck, catalogue.ORACLE[name])
    else:
        assert rows[1]


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
