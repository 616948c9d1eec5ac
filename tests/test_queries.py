"""Every core query with SQL against DuckDB, on the smallest tables; and the shape of the driver contract."""

import pytest

from tests.oracle import canonical, run_sql
from tickerloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    wanted = run_sql(SF, catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert canonical(found) == canonical(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
