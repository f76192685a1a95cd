"""The corpus queries run on the smallest tables, and agree with SQL where there is some."""

import pytest
from compare import ROOT, oracle_rows, spark_rows

from meshloom.llm import queries as Q

FOUND = {"p1_found": ["id", "line_no"], "p2_found": ["id_a", "id_b"], "p5_found": ["id"], "p6_found": ["id", "lang"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "hit", "kind"]}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    folder = f"{ROOT}/sf0.001"
    columns, rows = spark_rows(Q.QUERIES[name](spark, folder))
    assert rows and max(rows.values()) == 1
    if name in FOUND:
        assert columns == FOUND[name]
    if name in Q.ORACLE:
        assert (columns, rows) == oracle_rows(folder, Q.ORACLE[name])
