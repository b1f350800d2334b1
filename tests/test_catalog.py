"""Every core query against its SQL on the smallest tables."""

import pytest

from tessera.plans import catalog
from tests.oracle import DATA, check

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query = catalog.queries()[name]
    if name in SQL:
        check(spark, query, SQL[name], f"{DATA}/sf0.001")
    else:
        query(spark, f"{DATA}/sf0.001").collect()
