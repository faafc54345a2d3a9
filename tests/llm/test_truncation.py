import random

import pytest

pytest.importorskip("radveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from radveil.llm import truncation as T  # noqa: E402

SCHEMA = "doc_id long, text string, source string"


def corpus():
    rng = random.Random(1)
    nouns = "lung liver spleen kidney bladder femur".split()
    sentence = lambda: rng.choice(["The {} shows no change", "There is a small mass in the {}", "Compared with the last scan the {} is smaller"]).format(rng.choice(nouns)) + "."
    closing = ["Kind regards", "Page 3 of 4", "- " + "liver", "Size: 3 x 4 mm", "Diagnosis\nmild change", "(see addendum 2)", "Thank you"]
    rows, cut = [], set()
    for k in range(1200):
        text = " ".join(sentence() for _ in range(rng.randrange(4, 30)))
        source = rng.choice(["fixed", "free"])
        if source == "fixed" and len(text) > 400:
            text = text[:400]
            if not text.rstrip().endswith("."):
                cut.add(k)
            if rng.random() < 0.3 and k in cut:
                text += "…"
        elif rng.random() < 0.3:
            text += "\n" + rng.choice(closing)
        elif rng.random() < 0.05:
            text = text.rsplit(" ", 2)[0]
            if not text.endswith("."):
                cut.add(k)
        rows.append((k, text, source))
    return rows, cut


def test_cut_texts_are_found(spark):
    rows, cut = corpus()
    extra = [(5000, None, "free"), (5001, "", "free"), (5002, "  \n ", None), (5003, "Kind regards", None), (5004, "The lung shows no change. The list goes on...", "free")]
    df = spark.createDataFrame(rows + extra, SCHEMA).withColumn("n", F.lit(1)).withColumn("share", F.lit("clash")).withColumn("unit", F.lit(1))
    got = {r.doc_id for r in T.found(df).collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.03 * len(cut)
    limits = {(r.source, r.n) for r in T.significant(T.hazards(df)).where("unit = 'chars'").collect()}
    assert ("fixed", 400) in limits and not any(s == "free" for s, _ in limits)
    rates = {r.source: r for r in T.rates(df).collect()}
    assert rates["fixed"].n_cut > 50 and None in rates and rates[None].n_cut == 0


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, "word " * 100_000, "a"), (2, "x", None)], SCHEMA)
    assert T.found(df).count() == 0
    assert T.found(df.limit(0)).count() == 0 and T.rates(df.limit(0)).count() == 0


def test_copies_are_no_evidence(spark):
    nouns = "lung liver spleen kidney bladder femur colon ovary thymus tibia".split()
    rows = [(k, f"Compared with the last scan the {n} is smaller.", "a") for k, n in enumerate(nouns)]
    rows += [(100 + k, "No mass. Compared with the last scan the li", "a") for k in range(80)]
    rows += [(300 + k, "Nothing else.\nThe mass is", "b") for k in range(40)] + [(400 + k, f"The mass {w}.", "b") for k, w in enumerate(nouns)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in T.found(df).collect()} == {*range(100, 180), *range(300, 340)}
    assert {r.source: r.n_cut for r in T.rates(df).collect()} == {"a": 80, "b": 40}
    once = df.dropDuplicates(["source", "text"])
    assert sorted(map(tuple, T.lengths(df).collect())) == sorted(map(tuple, T.lengths(once).collect()))


def test_limit_is_that_of_benjamini_and_hochberg(spark):
    rng = random.Random(7)
    for n in (0, 1, 40, 400):
        ps = [rng.choice([rng.random(), rng.random() * 1e-3, 1e-9, 0.004]) for _ in range(n)]
        df = spark.createDataFrame([("s", "chars", k, p) for k, p in enumerate(ps)], "source string, unit string, n int, p double")
        ranked = sorted(ps)
        limit = max((p for k, p in enumerate(ranked, 1) if p <= T.FALSE_DISCOVERY * k / n), default=-1)
        assert {r.n for r in T.significant(df).collect()} == {k for k, p in enumerate(ps) if p <= limit}


def test_marks_longer_than_the_tail(spark):
    df = spark.createDataFrame([(1, "The lung shows no ch" + " [more]" * 30, "a"), (2, "The lung" + "…" * 200, "a"), (3, "x" * 100 + " [more]", "a")], SCHEMA)
    assert {r.doc_id: r.bare for r in T.pieces(df).collect()} == {1: "The lung shows no ch", 2: "The lung", 3: "x" * 100}


def test_cut_tokens_of_any_length_are_looked_up(spark):
    long = "Otorhinolaryngologicalexaminations"
    rows = [("one", long, 5, 5), ("one", long[:26] + "zz", 7, 1), ("one", "Otter", 3, 3)]
    stats = spark.createDataFrame([(1, k, n, t) for _, k, n, t in rows], "level int, key string, n long, terminated long")
    wanted = spark.createDataFrame([(x,) for x in ("Ot", "Otorh", long[:25], long[:30], long, "Z")], "one string")
    got = {r.one: (r.n0, r.t0) for r in T.beginnings(stats, wanted).collect()}
    assert got == {"Ot": (15, 9), "Otorh": (12, 6), long[:25]: (12, 6), long[:30]: (5, 5), long: (5, 5)}
