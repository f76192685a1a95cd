"""Every query of the core that has SQL, against it, on the smallest tables."""

import pytest
from compare import ROOT, oracle_rows, spark_rows

from meshloom.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    folder = f"{ROOT}/sf0.001"
    got, want = spark_rows(catalog.queries()[name](spark, folder)), oracle_rows(folder, SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, f"{ROOT}/sf0.001").count() > 0
