"""Every query of the catalog against its SQL, on the smallest tables."""

import pytest

from prismview.plans.derived import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, small, capsys):
    from prismview.operators.project import filters
    from prismview.spec import ViewSpec

    df = spark.read.parquet(f"{small}/lineitem.parquet").select("l_quantity", "l_tax")
    for f in filters(ViewSpec((), (), ranges=(("l_quantity", 5.0, 9.0),))):
        df = df.where(f)
    df.explain("formatted")
    said = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_quantity,5.0)" in said and "l_extendedprice" not in said
