"""The registered pN_ queries on the smallest tables."""

import os

import pytest

from lodeflow.llm.queries import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["row_id_a", "row_id_b"], "p2_found": ["row_id", "kind"], "p3_found": ["record_id", "field", "turn", "defect"], "p4_found": ["row_id_a", "row_id_b"],
    "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "subject"],
}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    found = queries()[name](spark, SMALL)
    if name in COLUMNS:
        assert found.columns == COLUMNS[name]
        assert found.distinct().count() == found.count()
    else:
        assert found.count() > 0
