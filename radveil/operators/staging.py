"""From records and clusters to the identity map and the staged, scrubbed and checked table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions.scrub import scrub_fields
from ..schemas import SECTION_FIELDS, STAGED, TEXT_FIELDS
from ..session import Stage
from . import qa
from .inventory import patient_sequence


def identity_map(recs: DataFrame, research: DataFrame, reports: DataFrame, encounters: DataFrame) -> DataFrame:
    """One row per record with all its identifiers; restricted."""
    ids = recs.join(research, "uid").join(reports, "uid").join(encounters, "uid")
    return ids.select("uid", F.col("rel").alias("source"), "id_no", F.col("parsed.header.patient_name").alias("patient_name"), "sex", F.col("parsed.header.age").alias("age_raw"), F.date_format("report_date", "yyyy-MM-dd").alias("report_date"), "pik.pik", "pik.masked_name", "research_patient_id", "report_id", "encounter_id")


def staged(recs: DataFrame, identity: DataFrame, shifts: DataFrame, images: DataFrame, pending: DataFrame, overrides: DataFrame, block_pending: bool = True) -> DataFrame:
    """The staged table: ids, sequence, shifted dates, classes, scrubbed fields, QA status and issues (array 'issues' too)."""
    stage = Stage(recs.sparkSession, "staging")
    body = recs.select("uid", F.concat_ws("\n", *(F.nullif(F.col(f"parsed.sections.{f}"), F.lit("")) for f in SECTION_FIELDS)).alias("body"))
    vocab = stage.write(qa.vocabulary(body, "body"))
    stems = V.filename_tokens(F.col("path"))
    names = recs.select(F.col("parsed.header.patient_name").alias("name")).unionByName(recs.select(F.array_join(stems, " ").alias("name")))
    others = stage.write(qa.other_names(names, "name", vocab))
    base = recs.withColumns({"stem_tokens": stems, "patient_name": F.col("parsed.header.patient_name")})
    terms = qa.term_sets(base.select("uid", "patient_name", "stem_tokens", "meta"), vocab, "uid", "patient_name", "stem_tokens", "meta")
    ids = identity.select("uid", "research_patient_id", "report_id", "encounter_id")
    rows = recs.join(ids, "uid").join(shifts, "research_patient_id").join(terms, "uid").join(pending.withColumn("pending", F.lit(True)), "uid", "left")
    rows = with_images(rows, images)
    rows = patient_sequence(rows, "research_patient_id", "report_date", "report_id")
    sources = F.array(*(F.col("parsed.header.examined") if f == "exam" else F.col(f"parsed.sections.{f}") for f in TEXT_FIELDS))
    rows = scrub_fields(rows.withColumn("sources", sources), "sources", "own", "id_no", "shift_days")
    rows = rows.withColumns({f: F.get("scrubbed", k) for k, f in enumerate(TEXT_FIELDS)})
    checked = qa.record_issues(rows, others, block_pending)
    answers = overrides.groupBy("report_id").agg(F.max(F.lower(F.trim(F.coalesce("decision", F.lit(""))))).alias("decision"))
    checked = checked.join(answers, "report_id", "left")
    out = checked.withColumns(
        {
            "report_date_shifted": V.shifted(F.col("report_date"), F.col("shift_days")),
            "age_band": V.age_band(F.col("age")),
            "age": V.age_text(F.col("age")),
            "modality": F.col("cls.modality"),
            "contrast": F.col("cls.contrast"),
            "body_region": F.col("cls.body_region"),
            "qa_status": qa.status(F.col("decision"), F.col("issues")),
            "qa_issues": F.array_join("issues", ";"),
        }
    )
    return stage.write(out.select(*STAGED.names, "uid", F.col("rel").alias("source_file"), "issues", F.coalesce("decision", F.lit("")).alias("decision")))


def with_images(rows: DataFrame, images: DataFrame) -> DataFrame:
    """rows with study_id (empty where there is none) and image_available. images: (uid, study_id), a row per uid."""
    got = rows.join(images.select("uid", "study_id"), "uid", "left").withColumn("image_available", F.col("study_id").isNotNull())
    return got.withColumn("study_id", F.coalesce("study_id", F.lit("")))


def issue_rows(rows: DataFrame) -> DataFrame:
    """Rows with an issue or any override, for the reviewer; null issues or decisions count as none."""
    return rows.where((F.coalesce(F.size("issues"), F.lit(0)) > 0) | (F.coalesce("decision", F.lit("")) != "")).select("report_id", "source_file", "qa_status", F.col("qa_issues").alias("issues"))
