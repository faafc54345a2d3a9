import pytest
from pyspark.sql import functions as F

from radveil.functions import fixed as X
from radveil.operators import imaging, qa, release, state

FIELDS = "exam clinical_information technique findings impression advice".split()


def test_issue_order(spark):
    schema = "uid string, " + ", ".join(f"{f} string" for f in FIELDS) + ", own array<string>, staff array<string>, id_no string, scrub_counts map<string,int>, warnings array<string>, pending boolean"
    rows = [
        ("a", None, "rahima", "", "x zoman writes A12 to a@b.cd 123456", None, "", ["rahima", "al"], ["zoman"], "A12", {"name": 1}, ["no_impression", "no_findings"], True),
        ("b", None, None, None, None, None, None, [], [], None, {}, ["no_header"], None),
        ("c", "CT", "fine", "ok", "clear", "normal", "", [], [], "a12", {}, [], False),
    ]
    names = spark.createDataFrame([("rahima",), ("writes",)], "word string")
    got = {r.uid: r.issues for r in qa.record_issues(spark.createDataFrame(rows, schema), names).collect()}
    assert got["a"] == ["own_name_token:rahima", "id_no_in_text", "email_pattern", "long_number_pattern", "metadata_person_token:zoman", "possible_name_token:writes", "patient_name_was_in_body_check_scrub", "parse:no_impression", "linkage_pending_review"]
    assert got["b"] == ["parse:no_header", "missing_clinical_content"]
    assert got["c"] == []


def test_status_and_sample(spark):
    df = spark.createDataFrame([(" PASS", ["x"]), ("fail", []), ("", ["x"]), (None, [])], "d string, i array<string>")
    assert [r[0] for r in df.select(qa.status(F.col("d"), F.col("i"))).collect()] == ["passed_override", "failed", "failed", "passed"]
    ns = spark.createDataFrame([(10,), (100,), (1000,), (610,), (0,)], "n long")
    assert [r[0] for r in ns.select(qa.sample_size(F.col("n"))).collect()] == [10, 30, 50, 30, 0]
    assert qa.human_sample(spark.range(100).select(F.col("id").cast("string").alias("k")), "k").count() == 30


def test_gate(spark):
    s = lambda *v: spark.createDataFrame([(x,) for x in v], "reviewer_ok string")
    assert release.gate(s("yes", " YES ")) == 2
    for bad in (s(), s("yes", "no"), s(None)):
        with pytest.raises(release.ReleaseBlocked):
            release.gate(bad)


def test_small_cells(spark):
    rows = [("F", "40-44", "CT", f"p{i % 4}") for i in range(9)] + [("M", "40-44", "CT", f"p{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "sex string, age_band string, modality string, research_patient_id string")
    assert [tuple(r) for r in release.small_cells(df).collect()] == [("F", "40-44", "CT", 4)]


def headers(spark, rows):
    return spark.createDataFrame(rows, "file string, tags map<string,string>")


def test_nearest_report(spark):
    ident = spark.createDataFrame([("u2", "A 1", "2024-01-10"), ("u1", "a1", "2024-01-10"), ("u0", "A1", "2024-01-14"), ("u5", "A1", None), ("u6", None, "2024-01-10")], "uid string, id_no string, report_date string")
    h = headers(spark, [("f1", {"PatientID": "A1", "StudyDate": "20240112"}), ("f2", {"PatientID": "A1", "StudyDate": "20240118"}), ("f3", {"PatientID": "A1", "StudyDate": "2024012"}), ("f4", {"AccessionNumber": "a1", "StudyDate": "20240113"}), ("f5", {"PatientID": "A1", "StudyDate": "20240230"}), ("f6", None)])
    got = {r.file: (r.uid, r.distance) for r in imaging.nearest_report(h, ident).collect()}
    assert got == {"f1": ("u0", 2), "f4": ("u1", 3)}
    assert imaging.unlinked(h, imaging.nearest_report(h, ident)).count() == 4


def test_deidentified(spark):
    tags = {"PatientID": "A1", "PatientName": "X", "StudyDate": "20240112", "ContentDate": "bad", "AccessionNumber": "9", "PatientAge": "093Y", "StudyInstanceUID": "1.2", "Modality": "US", "OperatorsName": "Q", "KVP": "120"}
    ident = spark.createDataFrame([("u1", "RP-1")], "uid string, research_patient_id string")
    linked = spark.createDataFrame([("f", "u1")], "file string, uid string")
    shifts = spark.createDataFrame([("RP-1", 3)], "research_patient_id string, shift_days int")
    r = imaging.deidentified_headers(headers(spark, [("f", tags)]), linked, ident, shifts).first()
    assert r.needs_pixel_review and r.study_id == r.tags["StudyInstanceUID"] and r.study_id.startswith("2.25.")
    t = {k: v for k, v in r.tags.items() if k != "StudyInstanceUID"}
    assert t == {"PatientID": "RP-1", "PatientName": "RP-1", "StudyDate": "20240115", "ContentDate": "bad", "PatientAge": "090Y", "Modality": "US", "KVP": "120", "PatientIdentityRemoved": "YES", "DeidentificationMethod": X.DEIDENTIFICATION_METHOD}


def test_set_if_absent(spark):
    old = spark.createDataFrame([("p1", 5)], "p string, shift_days int")
    got = {r.p: r.shift_days for r in state.set_if_absent(old, spark.createDataFrame([("p1",), ("p2",), ("p2",), (None,)], "p string"), "p", state.random_shifts(3)).collect()}
    assert got["p1"] == 5 and set(got) == {"p1", "p2"} and got["p2"] in {-3, -2, -1, 1, 2, 3}


def test_no_person_stays_in_a_header(spark):
    gone = ["PhysiciansOfRecord", "RequestingPhysician", "NameOfPhysiciansReadingStudy", "ResponsiblePerson", "OperatorsName", "SomeNewReaderName", "FutureApprover", "InstitutionName", "ReferencedStudySequence[0].ReferringPhysicianName", "RequestAttributesSequence[1].StudyComment", "(0009,1001)", "00291010", "PrivateCreator", "A[0].(0011,10aa)"]
    kept = ["ManufacturerModelName", "KVP", "SequenceName", "ReferencedStudySequence[0].ReferencedSOPInstanceUID", "(0008,103e)", "StudyDescription"]
    df = spark.createDataFrame([(k,) for k in gone + kept], "k string")
    assert {r.k for r in df.where(imaging.is_gone(F.col("k"))).collect()} == set(gone)
    linked, shifts = spark.createDataFrame([("f", "u1")], "file string, uid string"), spark.createDataFrame([("RP-1", 3)], "research_patient_id string, shift_days int")
    ident = spark.createDataFrame([("u1", "RP-1")], "uid string, research_patient_id string")
    r = imaging.deidentified_headers(headers(spark, [("f", None)]), linked, ident, shifts).first()
    assert r.study_id == "" and set(r.tags) == {"PatientName", "PatientID", "PatientIdentityRemoved", "DeidentificationMethod"}


def test_first_sex_is_that_of_the_first_file(spark):
    rows = [("p", "M", 2, "r2", 1, "30-34", "CT", None), ("p", "F", 1, "r1", 7, "25-29", "MRI", 4), ("p", "U", 3, "r0", None, "30-34", "CT", 9)]
    df = spark.createDataFrame(rows, "research_patient_id string, sex string, report_seq int, report_id string, file_index int, age_band string, modality string, days_since_first_report int")
    r = release.patient_rollup(df).first()
    assert (r.sex, r.first_age_band, r.follow_up_days, r.modalities) == ("M", "25-29", 9, "CT;MRI")
