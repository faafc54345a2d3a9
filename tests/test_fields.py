import datetime as dt
import difflib

import pytest
from pyspark.sql import functions as F

from radveil.functions import fields as V
from radveil.functions import keys as K
from radveil.functions.similarity import jaro_winkler, may_reach


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_dates(spark):
    d = dt.date(2024, 10, 12)
    cases = {"12 October 2024": d, "October 12, 2024": d, "12/10/2024": d, "2024-10-12": d, "12th Oct 24": d, "12 Octobr 2024": d, "30/02/2024": None, "3 Agust 2024": dt.date(2024, 8, 3), "": None, "soon": None, "১২/১০/২০২৪": d}
    assert column(spark, [*cases, None], V.parse_date) == [*cases.values(), None]


def test_ages(spark):
    cases = {"47 Yrs": 47, "6 Months": 0.5, "10 D": 10 / 365.25, "4 W": 4 / 52.18, "45 M": 3.75, "6 Mints": 6, "130": None, "": None, "৪৭": 47}
    got = column(spark, [*cases, None], V.parse_age_years)
    assert got == pytest.approx([*cases.values(), None])
    assert column(spark, [47.9, 90.0, None], V.age_text, "double") == ["47", "90+", ""]
    assert column(spark, [47.9, 90.0, None], V.age_band, "double") == ["45-49", "90+", ""]


def test_sex_and_birth_year(spark):
    assert column(spark, ["Male", " f", "", None, "x"], V.parse_sex) == ["M", "F", "U", "U", "U"]
    df = spark.createDataFrame([(dt.date(2024, 10, 26), 45.0), (None, 3.0)], "d date, a double")
    assert [r[0] for r in df.select(V.birth_year(F.col("d"), F.col("a"))).collect()] == [1979, None]


def test_folder_dates_and_stems(spark):
    assert column(spark, ["3-4-2020", "31-2-2020", "x3-4-2020", None], V.folder_date) == [dt.date(2020, 4, 3), None, None, None]
    assert column(spark, ["/a/b/Abc Def 12.x.DOC", None, "/a/.doc"], V.filename_tokens) == [["abc", "def"], [], ["doc"]]


def test_exam_classes(spark):
    rows = [("HRCT of chest", "", ""), ("CTA of brain", "", ""), ("plain X-ray chest", "", ""), ("", "", "CT SCAN REPORT"), (None, None, None)]
    df = spark.createDataFrame(rows, "e string, t string, h string").select(V.exam_class(F.col("e"), F.col("t"), F.col("h")).alias("c"))
    got = [tuple(r.c) for r in df.collect()]
    assert got == [("HRCT", "unspecified", "chest"), ("CT angiography", "unspecified", "brain/head;vascular"), ("X-ray", "without contrast", "chest"), ("CT", "unspecified", "unspecified"), ("other", "unspecified", "unspecified")]


def test_name_keys(spark):
    names = ["Hossain", "Hussain", "Rahman", "Chowdhury", "Begum Rahima", "Rahima Begum", "Md. X", None]
    assert column(spark, names, K.masked_name) == ["hsn", "hsn", "rmn", "cdr", "bgm rm", "bgm rm", "", ""]
    assert column(spark, ["Tymczak", "Pfister", "Ashcraft", "Honeyman", "", None, "12"], K.soundex) == ["T522", "P236", "A261", "H555", "NA", "NA", "NA"]
    assert column(spark, [1979, 1980, None], K.birth_year_range, "int") == ["1975-1979", "1980-1984", "NA"]


def test_keyed_hash(spark, tmp_path):
    import base64
    import hashlib
    import hmac

    values = ["a", "Zoë", "", None]
    secret = K.PUBLIC_TEST_KEY.secret
    want = [None if v is None else hmac.new(secret, f"idno\x1f{v}".encode(), hashlib.sha256).hexdigest()[:20] for v in values]
    assert column(spark, values, lambda c: K.keyed_hash(c, "idno", n=20)) == want
    key = tmp_path / "k"
    key.write_text(base64.b64encode(b"x" * 32).decode())
    by_file = K.LinkKey(key_file=str(key))
    df = spark.createDataFrame([(v,) for v in values], "v string").select(K.keyed_hash(F.col("v"), "idno", by_file).alias("h"))
    assert by_file.bytes().hex() not in df._jdf.queryExecution().toString()
    assert [r.h for r in df.collect()] == [None if v is None else hmac.new(by_file.bytes(), f"idno\x1f{v}".encode(), hashlib.sha256).hexdigest()[:32] for v in values]


def test_jaro_winkler():
    assert jaro_winkler("abc", "abc") == 1
    assert jaro_winkler("", "abc") == 0
    assert jaro_winkler("abcxyz", "bcaxyz") == pytest.approx(0.91667, abs=1e-5)
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-3)


def test_quick_look_loses_no_similar_pair():
    import random

    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 12)))
    for _ in range(20_000):
        a, b = word(), word()
        if jaro_winkler(a, b) >= 0.92:
            assert may_reach(a, b, 0.92)


def test_fuzzy_month_is_difflib():
    for w in ("agust", "septembr", "januray", "xxxx"):
        near = difflib.get_close_matches(w, ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"], 1, 0.7)
        assert (V.fuzzy_month(w) is None) == (not near)
