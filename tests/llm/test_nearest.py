import datetime as dt
import random

import pytest

pytest.importorskip("radveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from radveil.llm import nearest as N  # noqa: E402

H, I = "file string, patient_id string, study_date string", "uid string, id_no string, report_date string"


def test_against_all_pairs(spark):
    rng = random.Random(3)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(120))
    ident = [(f"u{i:03d}", rng.choice(["A1", "a 1", "B2", "C3", None]), rng.choice([day().isoformat(), day().isoformat(), None])) for i in range(90)]
    heads = [(f"f{i:03d}", rng.choice(["A1", " a1", "B2", "c3", "D", None]), day().strftime("%Y%m%d")) for i in range(150)]
    norm = lambda x: "".join(x.split()).lower() if x else None
    want = {}
    for f, p, s in heads:
        sd = dt.datetime.strptime(s, "%Y%m%d").date()
        c = [(abs((dt.date.fromisoformat(r) - sd).days), u) for u, n, r in ident if r and norm(n) and norm(n) == norm(p)]
        c = [x for x in c if x[0] <= 3]
        if c:
            want[f] = min(c)[1]
    h = spark.createDataFrame(heads, H).withColumn("uid", F.lit("clash")).withColumn("lo", F.lit(1)).withColumn("block", F.lit(1))
    i = spark.createDataFrame(ident * 2, I).withColumn("file", F.lit("clash")).withColumn("key", F.lit(1))
    assert {r.file: r.uid for r in N.found(h.union(h), i).collect()} == want
    assert N.found(h.union(h), i).count() == len(want)


def test_dates_and_ids(spark):
    bad = ["2020113", "20200231", "2020-1-1", "2020010１", " 20200101", None, "", "00000101"]
    h = spark.createDataFrame([(f"f{k}", "A", b) for k, b in enumerate(bad)] + [("ok", "a ", "20200102"), ("no", "", "20200102")], H)
    i = spark.createDataFrame([("u", "A", "2020-01-01"), ("v", " ", "2020-01-01"), ("w", "A", "soon")], I)
    assert [tuple(r) for r in N.found(h, i).collect()] == [("ok", "u")]
    assert N.found(h.limit(0), i).count() == N.found(h, i.limit(0)).count() == 0


def test_ties_and_tolerance(spark):
    i = spark.createDataFrame([("b", "A", "2020-01-01"), ("a", "A", "2020-01-05"), ("c", "A", "2020-01-20")], I)
    days = {"20200102": "b", "20200103": "a", "20200104": "a", "20200108": "a", "20200109": None, "20191229": "b", "20191228": None, "20200117": "c"}
    h = spark.createDataFrame([(d, "A", d) for d in days], H)
    assert {r.file: r.uid for r in N.found(h, i).collect()} == {k: v for k, v in days.items() if v}
