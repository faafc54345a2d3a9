import glob
import os
from collections import Counter

import duckdb
import pytest

from radveil.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, con):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(str([rounded(r[c]) for c in cols]) for r in df.collect())
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert got == Counter(str([rounded(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
