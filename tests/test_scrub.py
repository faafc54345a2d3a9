import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from radveil.functions.scrub import day_of, scrub_fields, shift_dates


def scrub(spark, texts, terms=(), id_no=None, days=10):
    df = spark.createDataFrame([(t, list(terms), id_no, days) for t in texts], "t string, terms array<string>, id_no string, days int")
    got = scrub_fields(df.selectExpr("array(t) as texts", "terms", "id_no", "days"), "texts", "terms", "id_no", "days").collect()
    return [(r.scrubbed[0], r.scrub_counts) for r in got]


def test_patterns(spark):
    cases = {
        "Reviewed by Dr. Rahman and advised follow up CT.": "Reviewed by [CLINICIAN]up CT.",
        "drain left in situ": "drain left in situ",
        "01712345678": "[PHONE]",
        "88 01712-345678": "[PHONE]",
        "+88-01712 345678": "[PHONE]",
        "+8801712345678": "+[NUMBER]",
        "01712-345-678": "01712-345-678",
        "mail a.b@x.com. Next": "mail [EMAIL] Next",
        "12 mar 202": "[DATE]",
        "12 October 2024": "2024-10-22",
    }
    assert [t for t, _ in scrub(spark, [*cases])] == [*cases.values()]


def test_own_terms(spark):
    got = scrub(spark, ["rahima at A.12 seen; RAHIMA a.12", None, ""], ["rahima", "x"], "A.12")
    assert got[0] == ("[NAME] at [ID] seen; [NAME] [ID]", {"id_no": 2, "name": 2})
    assert got[1] == ("", {}) and got[2] == ("", {})
    assert scrub(spark, ["a.12"], [], None)[0] == ("a.12", {})


@settings(max_examples=60, deadline=None)
@given(st.dates(dt.date(1990, 1, 1), dt.date(2050, 12, 31)), st.integers(-365, 365))
def test_shift_keeps_interval(day, n):
    assert shift_dates(f"on {day:%d/%m/%Y} x", n) == f"on {(day + dt.timedelta(n)).isoformat()} x"
    assert day_of(f"{day.day} {day:%B} {day.year}") == day
