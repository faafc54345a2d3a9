import random
import re

import pytest

pytest.importorskip("radveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from radveil.llm import oddsketch as O  # noqa: E402

SCHEMA = "report_id string, technique string, findings string"


def brute(rows, n=3, t=0.5, least=20):
    sets = {}
    for i, a, b in rows:
        w = re.findall("[a-z0-9]+", f"{a or ''} {b or ''}".lower())
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 90))]
        for v in range(rng.randrange(1, 5)):
            words = [w if rng.random() > 0.04 * v else rng.choice(vocab) for w in base]
            cut = rng.randrange(len(words))
            rows.append((f"r{f:02d}{v}", " ".join(words[:cut]), " ".join(words[cut:])))
    return rows


def test_no_link_between_different_texts_is_lost(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit("clash")).withColumn("key", F.lit(1))
    got = {tuple(r) for r in O.found(df.union(df)).collect()}
    assert got == brute(rows)
    assert O.found(df.limit(0)).count() == 0


def test_copies_stay_linear_and_edges(spark):
    text = " ".join(f"t{i}" for i in range(30))
    near = text.replace("t3 ", "x ")
    rows = [(f"c{i:02d}", text.upper() if i % 2 else text, None) for i in range(40)] + [("n1", near, ""), ("n2", near, None), ("e", None, None), ("s", "one two", "three"), (None, text, None), ("long", " ".join(f"q{i % 5000}" for i in range(50_000)), "x")]
    got = {tuple(r) for r in O.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute([r for r in rows if r[0]])
    assert got <= want
    assert {("c00", f"c{i:02d}") for i in range(1, 40)} <= got
    assert {(f"c{i:02d}", "n1") for i in range(40)} <= got and ("n1", "n2") in got
    assert len(got) == 39 + 1 + 41


def test_groups(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [("a", text, ""), ("b", text, None), ("c", text.replace("t50 ", "x "), ""), ("d", " ".join(f"z{i}" for i in range(40)), "")]
    got = {r.report_id: (r.group_id, r.n_links) for r in O.grouped(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "d": ("d", 0)}


def test_estimate_is_near_the_truth(spark):
    from radveil.session import Stage

    rows = corpus(8)
    stage = Stage(spark, "t")
    _, signed = O.signed_classes(spark.createDataFrame(rows, SCHEMA), "report_id", O.report_text(), 3, 20, stage)
    a, b = signed.select("cls", "sketch", "shingles"), signed.select(F.col("cls").alias("c2"), F.col("sketch").alias("s2"), F.col("shingles").alias("h2"))
    both = a.join(b, F.col("cls") < F.col("c2")).withColumn("e", O.estimate(F.col("sketch"), F.col("s2"), O.BANDS * O.ROWS, O.SKETCH_WORDS))
    n = F.size(F.array_intersect("shingles", "h2"))
    for r in both.select("e", (n / (F.size("shingles") + F.size("h2") - n)).alias("j")).where("j >= 0.5").collect():
        assert r.e >= 0.5 - O.SLACK and abs(r.e - r.j) < 0.2
