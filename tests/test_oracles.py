"""Every registered query of the operators against its SQL, and those without one for rows alone."""

import pytest

from larkspur.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(repr, df.select(*[f"`{c}`" for c in columns]).toPandas().itertuples(index=False, name=None)))
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(want.columns) == columns
    assert got == sorted(map(repr, want[columns].itertuples(index=False, name=None)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["user", "item", "rating", "rank", "large_order"]
    assert set(e.oracle_sql()) <= set(e.queries())
