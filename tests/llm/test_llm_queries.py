import os

import pytest

from srcweave.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {"p1_found": ["place", "record_id", "line_no"], "p2_found": ["file_id"], "p3_found": ["id_a", "id_b"], "p4_found": ["file_id"], "p5_found": ["file_id", "line_no"], "p6_found": ["id_a", "id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "line_no", "lang"]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    assert df.count() >= 0
