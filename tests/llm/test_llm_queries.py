import glob
import os
from collections import Counter

import duckdb
import pytest

pytest.importorskip("radveil.llm")

from radveil.llm.queries import QUERIES, SQL  # noqa: E402

COLUMNS = {"p1_found": "file_index field", "p2_found": "uid group_id", "p3_found": "report_id field kind", "p4_found": "file uid", "p5_found": "uid_a uid_b", "p6_found": "report_a report_b", "p7_found": "uid field", "p8_ids": "doc_id ids", "p9_found": "doc_id item_id", "p10_found": "doc_id"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data):
    df = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    got = Counter(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
    if name in COLUMNS:
        assert not got or max(got.values()) == 1
    if name in SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        cur = con.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert got == Counter(str([r[names.index(c)] for c in sorted(df.columns)]) for r in cur.fetchall())
