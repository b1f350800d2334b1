"""Every query of the subpackage on the smallest tables; none gives a row twice."""

import pytest

from tessera.llm import catalog
from tests.oracle import DATA, check

COLUMNS = {
    "p1_found": ["file_path"], "p2_found": ["id_a", "id_b"], "p3_found": ["id", "line"], "p4_found": ["path"], "p6_found": ["id"],
    "p7_found": ["id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query, sf = catalog.queries()[name], f"{DATA}/sf0.001"
    if name in catalog.oracle_sql():
        check(spark, query, catalog.oracle_sql()[name], sf)
    df = query(spark, sf)
    rows = [str(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    assert df.columns == COLUMNS.get(name, df.columns)
