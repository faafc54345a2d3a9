import pytest

pytest.importorskip("radveil.llm")

from pyspark.sql import functions as F  # noqa: E402

from radveil.llm import residue as R  # noqa: E402

SCHEMA = "uid string, findings string, impression string"
BAD = ["{{size_mm}} as described.", "${side} noted.", "«organ» measured.", "[LOBE]", "%SIDE%", "The <<level>> is normal.", "A lesion of [size] mm is seen in segment [ ].", "measuring ___ x ___ mm.", "Size: .... cm", "TBD - dictate side", "Lorem filler, lorem filler, replace before signing", "blah blah blah", "Error 404 - page for this study could not be found on the viewer", "<html><head><title>502 Bad Gateway</title></head></html>", "Please turn on JavaScript to view this report.", "Your session has ended. Sign in again to continue.", "[object Object]", "undefined", "Hounsfield value ??? HU (complete)."]
GOOD = ["Nil.", "As before.", "A fixation template plate is in place.", "Access to the joint space is denied by overlying metal.", "Script from the pharmacy noted: steroid cover.", "Test bolus was given first.", "Undefined margins of the mass.", "Grade 3/5 stenosis [left].", "Discussed with [CLINICIAN]; [NAME] told.", "Size 12 x 14 mm <20 mm threshold.", "Page 2 of the film set was reviewed.", "------ end of series ------", "Service lift transfer; supine only.", "100% of the lumen is open."]


def test_forms(spark):
    rows = [(f"b{k}", f"Lungs are clear.\n{t}\nHeart is normal.", None) for k, t in enumerate(BAD)] + [(f"g{k}", t, "") for k, t in enumerate(GOOD)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shape", F.lit("clash")).withColumn("segment", F.lit(1)).withColumn("field", F.lit(1))
    got = {(r.uid, r.field) for r in R.found(df.union(df)).collect()}
    assert got == {(f"b{k}", "findings") for k in range(len(BAD))}
    assert R.found(df.limit(0)).count() == 0


def test_labels_spread_to_near_duplicates_only(spark):
    seed = "This report template could not be found on the departmental viewer, ask the duty clerk for the paper copy."
    near = seed.replace("could not be found", "could not be fuond").replace("paper copy", "paper copi")
    far = "The liver is of normal size and shows no focal lesion; the spleen is not enlarged."
    assert R.gram_similarity.func(__import__("pandas").Series([seed]), __import__("pandas").Series([near]))[0] > R.SIMILARITY
    rows = [("s", seed, None), ("n", near, None), ("f", far, None), ("x", None, seed), (None, seed, None)]
    got = {(r.uid, r.field) for r in R.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert ("s", "findings") in got and ("x", "impression") in got and ("f", "findings") not in got


def test_simhash_tables_meet_all_within_three_bits():
    import random

    rng = random.Random(0)
    for _ in range(200):
        h = rng.getrandbits(64)
        g = h
        for b in rng.sample(range(64), R.HAMMING):
            g ^= 1 << b
        assert any((h >> 16 * k) & 0xFFFF == (g >> 16 * k) & 0xFFFF for k in range(R.TABLES))


def test_cleaned(spark):
    rows = [("a", "Lungs are clear. {{side}} seen. Heart is normal.", "undefined"), ("b", None, "fine."), ("c", "word " * 50_000, "")]
    got = {r.uid: r for r in R.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a"].findings == "Lungs are clear. Heart is normal." and got["a"].impression is None
    assert got["b"].findings is None and got["b"].impression == "fine."


def test_quick_looks_pass_every_form():
    import re

    from hypothesis import given, settings
    from hypothesis import strategies as st

    def check(text):
        if re.search("|".join(f"(?:{p})" for p in R.CASED), text) or re.search("|".join(f"(?:{p})" for p in R.PLACEHOLDER), text, re.I):
            assert re.search(R.MARKS, text), text
        for group in (R.WORDED, R.FILLER, R.ERROR, R.NOTICE):
            for form in group:
                if re.search(form, text, re.I):
                    assert len(text) <= R.SHORT or any(w in text.lower() for w in R.STEMS), text

    for form in R.PLACEHOLDER + R.WORDED + R.FILLER + R.ERROR + R.NOTICE:
        settings(max_examples=40, deadline=None)(given(st.from_regex(re.compile(form, re.I | re.A)))(check))()


def test_labels_come_from_a_sample_and_spread(spark):
    """Only the sample's residue is known by its form; equal and similar shapes elsewhere get their labels from it."""
    from radveil.session import Stage

    notice = "Your browser does not run scripts, so report {} cannot be shown here."
    segs = R.segments(spark.createDataFrame([(f"u{k}", f"Seen. Comment: {notice.format(k)}" if k % 2 else "Lungs are clear.", "Yuor browser does not run scripts, so report 7 cannot be shown here.") for k in range(60)] + [("z", "Lorem ipsum dolor.", None)], SCHEMA))
    first = {r.uid for r in segs.select("uid").distinct().orderBy(F.xxhash64("uid"), "uid").limit(5).collect()}
    assert "z" not in first
    got = {r.shape: r.hops for r in R.labelled_shapes(segs, Stage(spark, "t"), 5).collect()}
    assert got == {notice.format(0): 0, "Yuor browser does not run scripts, so report 0 cannot be shown here.": 0}
    worn = segs.where(~F.col("shape").startswith("Yuor") | ~F.col("uid").isin(*first))
    got = {r.shape: r.hops for r in R.labelled_shapes(worn, Stage(spark, "t"), 5).collect()}
    assert got[notice.format(0)] == 0 and got["Yuor browser does not run scripts, so report 0 cannot be shown here."] == 1 and len(got) == 2


def test_sizes_of_similar_texts_are_near(spark):
    import random

    import pandas as pd

    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(3, 90)))
        b = "".join(rng.choice("abc") if rng.random() < 0.04 else c for c in a) + rng.choice(["", "xy", a[:5]])
        if R.gram_similarity.func(pd.Series([a]), pd.Series([b]))[0] >= R.SIMILARITY:
            x, y = R.simhash.func(pd.Series([a, b]))["size"]
            assert abs(x - y) <= 1


def test_simhash_is_the_majority_of_the_bits(monkeypatch):
    import random

    rng = random.Random(2)
    texts = ["", "a", "é" * 5, *("".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 200))) for _ in range(40))]

    def plain(t):
        hs = [int(h) for h in R.gram_hashes(t)]
        v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        return v - (1 << 64) if v >> 63 else v

    assert R.simhashes(texts).tolist() == [plain(t) for t in texts]
    monkeypatch.setattr(R, "BLOCK", 50)
    assert R.simhashes(texts).tolist() == [plain(t) for t in texts]
    assert R.simhashes([]).tolist() == []


def test_unformed_near_duplicates_are_found(spark):
    seed = "This report template could not be found on the departmental viewer, ask the duty clerk for the paper copy."
    near = seed.replace("could not be found", "could not be fuond").replace("paper copy", "paper copi")
    notice = "Your browser does not run scripts, so this report cannot be shown here."
    worn = "Yuor browser does not run scrpts, so this report cannot be shown here."
    blank = "The anterior and posterior longitudinal ligaments are intact and the height of <<level>> is maintained."
    filled = blank.replace("<<level>>", "L4")
    rows = [(u, t, None) for u, t in {"s": seed, "near": near, "n": notice, "worn": worn, "blank": blank, "filled": filled}.items()]
    shapes = {t: R.gram_similarity.func(__import__("pandas").Series([a]), __import__("pandas").Series([b]))[0] for t, a, b in (("near", seed, near), ("worn", notice, worn), ("filled", blank, filled))}
    assert min(shapes.values()) >= R.SIMILARITY
    formed = spark.createDataFrame([(near,), (worn,)], "shape string").where(R.trusted(F.col("shape"))[0])
    assert formed.count() == 0
    assert {r.uid for r in R.found(spark.createDataFrame(rows, SCHEMA)).collect()} == {"s", "near", "n", "worn", "blank"}


def test_tables_meet_similar_segments(spark):
    import random

    import pandas as pd

    rng = random.Random(5)
    words = [r.w for r in spark.read.parquet("/root/testdata/sf0.001/parse_report.parquet").selectExpr("explode(split(findings, '[ \\n]+')) w").limit(3000).collect()]
    pairs = []
    while len(pairs) < 300:
        k = rng.randrange(len(words))
        a = " ".join(words[k : k + 10])
        b = "".join(rng.choice("abcdefghij") if rng.random() < 2 / max(1, len(a)) else c for c in a)
        if a != b and len(a) >= 25 and R.gram_similarity.func(pd.Series([a]), pd.Series([b]))[0] >= 0.8:
            pairs.append((a, b))
    near = [(int(x) ^ int(y)) & (1 << 64) - 1 for x, y in zip(*(R.simhashes(list(t)) for t in zip(*pairs)))]
    within = [d for d in near if d.bit_count() <= R.RADIUS]
    assert len(within) >= 0.98 * len(pairs)
    assert all(any((d >> 16 * k & 0xFFFF) in R.FLIPS for k in range(R.TABLES)) for d in within)


def test_templates_with_other_blanks_are_reached(spark):
    """What a sample taught about one blank holds for others, but not for the sentence with its blank filled in."""
    from radveil.session import Stage

    one, two = "[Error: could not load autotext 'lobe']", "[Error: could not load autotext 'side']"
    blank, filled = "measuring ___ x ___ mm in the {organ}.", "measuring 12 x 14 mm in the liver."
    df = spark.createDataFrame([("a", one, blank), ("b", two, filled), ("c", "Nothing here.", blank.replace("organ", "lobe"))], SCHEMA)
    segs = R.segments(df)
    for known in "abc":
        sample = segs.where(F.col("uid") == known)
        monkey = R.trusted_shapes
        try:
            R.trusted_shapes = lambda s, most, sample=sample: monkey(sample, most)
            got = {r.shape for r in R.labelled_shapes(segs, Stage(spark, "t")).collect()}
        finally:
            R.trusted_shapes = monkey
        want = {"a": {one, two, blank, blank.replace("organ", "lobe")}, "b": {one, two}, "c": {blank, blank.replace("organ", "lobe")}}[known]
        assert got == want, known


def test_residue_of_the_last_report_is_found(spark):
    """No report is left unread, however many there are; residue that stands in one of them only is found."""
    reports = spark.range(30_010).select(F.col("id").cast("string").alias("uid"))
    last = reports.orderBy(F.xxhash64("uid").desc(), F.col("uid").desc()).first().uid
    df = reports.select("uid", F.when(F.col("uid") == last, "Lorem ipsum dolor.").otherwise("Lungs are clear.").alias("findings"), F.lit(None).cast("string").alias("impression"))
    assert [tuple(r) for r in R.found(df).collect()] == [(last, "findings")]
