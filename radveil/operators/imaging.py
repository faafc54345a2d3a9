"""DICOM headers as rows: linkage to reports by number and nearest date, and de-identified tags."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions import keys as K

TOLERANCE = 3  # Fixed value: days between study and report


def study_day(text: Column) -> Column:
    """Day of exactly eight digits yyyymmdd; null otherwise and for impossible days."""
    ok = text.rlike("^[0-9]{8}$") & (F.substring(text, 1, 4) != "0000")
    return F.when(ok, F.try_to_date(F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)), "yyyy-MM-dd"))


def tag(name: str) -> Column:
    return F.element_at("tags", name)


def nearest_report(headers: DataFrame, identity: DataFrame, tolerance: int = TOLERANCE, key: K.LinkKey = K.PUBLIC_TEST_KEY) -> DataFrame:
    """(file, uid, distance): PatientID or AccessionNumber, without white space, equals the report's number, dates at most
    ``tolerance`` days apart; the nearest, at equal distance the smaller uid.

    Every study day meets only the days around it: the join is on number and day, so that a number with very many
    reports is spread over its days, and one row per number and day (smallest uid) stands for all its reports.
    Unusable dates, null numbers and null report dates match nothing.
    """
    reports = identity.select(K.id_normalised(F.col("id_no")).alias("no"), F.col("report_date").try_cast("date").alias("day"), "uid").where("no is not null and day is not null")
    per_day = reports.groupBy(K.keyed_hash(F.col("no"), "idno", key).alias("no"), "day").agg(F.min("uid").alias("uid"))
    numbers = F.array_distinct(F.array_compact(F.array(*(K.id_normalised(tag(t)) for t in ("PatientID", "AccessionNumber")))))
    studies = headers.select("file", F.explode(numbers).alias("no"), study_day(tag("StudyDate")).alias("study_day")).where("study_day is not null").distinct()
    around = studies.select("file", K.keyed_hash(F.col("no"), "idno", key).alias("no"), "study_day", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("__d")).withColumn("day", F.date_add("study_day", F.col("__d")))
    met = around.join(per_day, ["no", "day"])
    best = met.groupBy("file").agg(F.min(F.struct(F.abs("__d").alias("distance"), F.col("uid"))).alias("b"))
    return best.select("file", "b.uid", "b.distance")


def unlinked(headers: DataFrame, linked: DataFrame) -> DataFrame:
    """(file, reason) of the files without a report."""
    return headers.select("file").distinct().join(linked.select("file"), "file", "left_anti").withColumn("reason", F.lit("no report with matching ID NO within 3 days"))


def needs_pixel_review() -> Column:
    """Flag by burned-in annotation, modality or image type; missing tags count as empty."""
    has = lambda t: F.upper(F.coalesce(tag(t), F.lit("")))
    return (has("BurnedInAnnotation") == "YES") | F.coalesce(tag("Modality").isin(*X.PIXEL_RISK_MODALITIES), F.lit(False)) | has("ImageType").contains("SECONDARY") | has("ImageType").contains("SCREEN")


def new_uids(key: K.LinkKey):
    """Column function: '2.25.' and the decimal of 30 hex digits of the keyed hash (beyond 64 bits, so in Python)."""

    @F.pandas_udf(T.StringType())
    def f(old: pd.Series) -> pd.Series:
        secret = key.bytes()
        return old.map(lambda v: None if v is None else "2.25." + str(int(hmac.new(secret, f"dicom-uid{K.SEPARATOR}{v}".encode(), hashlib.sha256).hexdigest()[:30], 16)))

    return f


def is_gone(keyword: Column) -> Column:
    """Must a header entry go: listed ones with all beneath, private ones, person names at any depth.

    Entries inside sequences are named by their path, as 'RequestAttributesSequence[0].RequestingPhysician'; private ones
    have an odd group, as '(0009,1001)', or say so. Names are those of the dictionary's PN elements, and, so that an
    unknown keyword fails closed, whatever ends like a person or a name and is no known thing.
    """
    parts = F.split(F.regexp_replace(keyword, r"\[\d*\]", ""), r"\.")
    last = F.element_at(parts, -1)
    private = F.exists(parts, lambda p: p.rlike(r"(?i)private|^\(?[0-9a-f]{3}[13579bdf],?\s*[0-9a-f]{4}\)?$"))
    sounds = last.rlike(r"(?:Names?|Physicians?(?:OfRecord)?|Persons?|Operators?|Author|Recorder|Transcriber|Reviewer|Interpreter|Performer|Approver)$") & ~last.isin(*X.NO_PERSON_TAGS)
    return F.get(parts, 0).isin(*X.REMOVE_TAGS) | private | last.isin(*X.PERSON_NAME_TAGS) | sounds


def deidentified_headers(headers: DataFrame, linked: DataFrame, identity: DataFrame, shifts: DataFrame, key: K.LinkKey = K.PUBLIC_TEST_KEY) -> DataFrame:
    """(file, report_uid, study_id, needs_pixel_review, tags) of linked files.

    Listed, private and person-name entries go (is_gone); patient name and id become the research id; ages from 90 become
    090Y; the four dates move by the patient's shift; the four UIDs are remapped. Null or missing tags stay missing.
    """
    who = identity.groupBy("uid").agg(F.min("research_patient_id").alias("research_patient_id"))
    got = headers.dropDuplicates(["file"]).join(linked.select("file", "uid"), "file").join(who, "uid").join(shifts, "research_patient_id")
    remap = new_uids(key)
    for t in X.UID_TAGS:
        got = got.withColumn(f"__{t}", remap(tag(t)))
    gone = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, v: ~is_gone(k))
    age = lambda v: F.when(v.rlike(r"^\d{3}Y$") & (F.substring(v, 1, 3).try_cast("int") >= 90), F.lit("090Y")).otherwise(v)
    moved = lambda v: F.coalesce(F.date_format(F.date_add(study_day(v), F.col("shift_days")), "yyyyMMdd"), v)
    kept = F.transform_values(
        gone,
        lambda k, v: F.when(k == "PatientAge", age(v)).when(k.isin(*X.DATE_TAGS), moved(v)).when(k == X.UID_TAGS[0], F.col(f"__{X.UID_TAGS[0]}")).when(k == X.UID_TAGS[1], F.col(f"__{X.UID_TAGS[1]}")).when(k == X.UID_TAGS[2], F.col(f"__{X.UID_TAGS[2]}")).when(k == X.UID_TAGS[3], F.col(f"__{X.UID_TAGS[3]}")).otherwise(v),
    )
    own = {"PatientName": F.col("research_patient_id"), "PatientID": F.col("research_patient_id"), "PatientIdentityRemoved": F.lit("YES"), "DeidentificationMethod": F.lit(X.DEIDENTIFICATION_METHOD)}
    fixed = F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v)))
    tags = F.map_concat(F.map_filter(kept, lambda k, v: ~k.isin(*own)), fixed)
    return got.select("file", F.col("uid").alias("report_uid"), F.coalesce("__StudyInstanceUID", F.lit("")).alias("study_id"), needs_pixel_review().alias("needs_pixel_review"), tags.alias("tags"))


def image_links(deidentified: DataFrame) -> DataFrame:
    """(uid, study_id); of several studies of a report the one of the last file stands."""
    return deidentified.groupBy(F.col("report_uid").alias("uid")).agg(F.max_by("study_id", "file").alias("study_id"))
