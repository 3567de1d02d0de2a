"""Every query of the subpackage runs on the smallest data and, where it has SQL, gives the same rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from postloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
COLUMNS = {
    "p1_found": ["email_id", "line_no"], "p2_found": ["email_id", "copy_email_id"], "p3_found": ["record_type", "record_id"], "p4_found": ["record_type", "record_id", "field", "pii_type", "mention"], "p5_found": ["conv_email_id", "turn_no", "email_id"],
    "p6_found": ["syn_id", "field"], "p7_found": ["doc_id", "item_id"], "p8_found": ["mix_name", "source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    rows = Counter(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert name not in COLUMNS or max(rows.values(), default=1) == 1
    if name in queries.SQL:
        con = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        found = con.sql(queries.SQL[name])
        order = [list(found.columns).index(c) for c in sorted(df.columns)]
        assert rows == Counter(tuple(str(r[i]) for i in order) for r in found.fetchall())
