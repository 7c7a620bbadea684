"""Every query of the library against its SQL on the smallest tables."""

import pytest

from tests.compare import same_rows
from veredas import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.ORACLE:
        same_rows(df, duck, catalog.ORACLE[name])
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(catalog.ORACLE) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
