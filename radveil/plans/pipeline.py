"""The three entry points as plans: run, release, dicom."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import imaging, inventory, linkage, qa, release, staging, state
from ..session import Stage, ship
from ..sources import dicom
from ..sources import files as src
from ..sources import sinks
from ..sources.vault import Vault


@dataclass
class Config:
    # The defaults of the figures below.
    raw_dir: Path
    secure_dir: Path
    research_dir: Path
    key_file: Path
    converter: str | None = None
    limit: int | None = None
    max_shift_days: int = 365
    block_pending_linkage: bool = True
    human_qa_fraction: float = 0.05
    human_qa_min: int = 30
    k_min: int = 5


STATE = {
    "research_ids": "uid string, research_patient_id string",
    "report_ids": "uid string, report_id string",
    "encounter_ids": "uid string, encounter_id string",
    "date_shifts": "research_patient_id string, shift_days int",
    "image_links": "uid string, study_id string",
    "id_merges": "retired string, into string",
    "identity_map": "uid string, source string, id_no string, patient_name string, sex string, age_raw string, report_date string, pik string, masked_name string, research_patient_id string, report_id string, encounter_id string",
    "decisions": "pair_key string, decision string",
}


def _load(vault: Vault, spark: SparkSession, name: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    return vault.load(spark, name, _parse_datatype_string(STATE[name]))


def run_tables(files: DataFrame, cfg: Config, vault: Vault, decisions: DataFrame, overrides: DataFrame) -> dict[str, DataFrame]:
    """Steps 2 to 8 over extracted files; the tables by name, state included."""
    spark, key = files.sparkSession, vault.link_key
    stage = Stage(spark, "run")
    recs = stage.write(inventory.records(files, key))
    inv = inventory.inventory(files, recs, key)
    review, base = linkage.review_queue(recs)
    clusters, pending = linkage.apply_decisions(recs, review, base, decisions)
    pending = stage.write(pending)
    old = _load(vault, spark, "research_ids")
    research, retired = linkage.assign_research_ids(clusters, old)
    research = stage.write(research)
    ids = {}
    for name, column, prefix in (("report_ids", "report_id", "RR"), ("encounter_ids", "encounter_id", "EN")):
        ids[name] = stage.write(state.set_if_absent(_load(vault, spark, name), recs, "uid", lambda new, p=prefix, c=column: linkage.random_ids(new, p, c)))
    shifts = stage.write(state.set_if_absent(_load(vault, spark, "date_shifts"), research, "research_patient_id", state.random_shifts(cfg.max_shift_days)))
    identity = stage.write(staging.identity_map(recs, research, ids["report_ids"], ids["encounter_ids"]))
    rows = staging.staged(recs, identity, shifts, _load(vault, spark, "image_links"), pending, overrides, cfg.block_pending_linkage)
    # state is a superset: uids this run didn't see keep their ids
    kept = old.join(research.select("uid"), "uid", "left_anti").unionByName(research)
    return {
        "records": recs, "inventory": inv, "review": linkage.review_rows(review, decisions, identity), "review_pairs": review, "pending": pending, "staged": rows, "identity_map": identity,
        "research_ids": kept, "report_ids": ids["report_ids"], "encounter_ids": ids["encounter_ids"], "date_shifts": shifts, "id_merges": state.append_log(_load(vault, spark, "id_merges"), retired), "decisions": decisions,
    }


COUNTED = ("parse_warnings", "stop_reasons", "modality", "linkage_review_pairs", "qa_issue_counts")


def summary_rows(recs: DataFrame, inv: DataFrame, review: DataFrame, pending: DataFrame, rows: DataFrame) -> DataFrame:
    """(figure, value, n): the counters of a run. value is empty for single figures, else what is counted."""
    one = lambda df, **figures: df.agg(*(c.alias(k) for k, c in figures.items())).unpivot([], [*figures], "figure", "n").select("figure", F.lit("").alias("value"), "n")
    each = lambda figure, df, c: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(figure).alias("figure"), "value", "n")
    per = rows.groupBy("research_patient_id").agg(F.count("*").alias("k"))
    passed = F.col("qa_status").startswith("passed")
    parts = [
        one(recs, reports=F.count("*")),
        one(inv, duplicate_files=F.count_if(F.col("status") == "duplicate_file")),
        one(per, patients=F.count("*"), patients_with_multiple_reports=F.count_if(F.col("k") > 1)),
        each("parse_warnings", recs.select(F.explode("warnings").alias("w")), "w"),
        each("stop_reasons", recs.select(F.col("parsed.stop_reason").alias("r")), "r"),
        each("modality", recs.select(F.col("cls.modality").alias("m")), "m"),
        each("linkage_review_pairs", review, "reason"),
        one(pending, linkage_review_undecided_records=F.count("*")),
        one(rows, qa_passed=F.count_if(passed), qa_failed=F.count_if(~passed)),
        qa.issue_counts(rows).select(F.lit("qa_issue_counts").alias("figure"), F.col("issue").alias("value"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def run_summary(*tables: DataFrame) -> dict:
    """summary_rows as a dict; the rows are as few as there are figures, warnings and reasons."""
    out: dict = {k: {} for k in COUNTED}
    for figure, value, n in summary_rows(*tables).collect():
        if figure in COUNTED:
            out[figure][value] = n
        else:
            out[figure] = n
    return out


def run(spark: SparkSession, cfg: Config) -> dict:
    """Extract, parse, link, assign, scrub, check, persist; returns the summary."""
    began = time.time()
    ship(spark)
    vault = Vault(cfg.secure_dir, cfg.key_file)
    listed, locks = src.list_source_files(spark, str(cfg.raw_dir), cfg.limit)
    files = Stage(spark, "extract").write(src.extract(listed, str(cfg.raw_dir), src.find_converter(cfg.converter)))
    d = cfg.secure_dir
    answered = linkage.normalised_decisions(src.read_reviewer_csv(spark, str(d / "linkage_review.csv"), S.REVIEW).select("pair_key", "decision"))
    kept = _load(vault, spark, "decisions")
    decisions = Stage(spark, "decisions").write(kept.join(answered.where("decision <> ''"), "pair_key", "left_anti").unionByName(answered.where("decision <> ''")))
    if not (d / "qa_overrides.csv").exists():
        sinks.write_reviewer_csv(spark.createDataFrame([], S.OVERRIDES), d / "qa_overrides.csv", S.OVERRIDES.names)
    t = run_tables(files, cfg, vault, decisions, src.read_reviewer_csv(spark, str(d / "qa_overrides.csv"), S.OVERRIDES))
    sinks.write_csv_parts(t["inventory"].orderBy("file_index"), str(d / "inventory_csv"), S.INVENTORY_COLUMNS)
    sinks.write_reviewer_csv(t["review"], d / "linkage_review.csv", S.REVIEW_COLUMNS)
    rows = t["staged"]
    sinks.write_bulk(rows.select(*S.STAGED.names), str(d / "staging_deid.jsonl"), "json")
    sinks.write_csv_parts(staging.issue_rows(rows), str(d / "qa_issues_csv"), ["report_id", "source_file", "qa_status", "issues"])
    sample = d / "qa_human_sample.csv"
    if not sample.exists():
        drawn = qa.human_sample(rows.where("qa_status like 'passed%'"), "report_id", cfg.human_qa_fraction, cfg.human_qa_min)
        blank = {c: F.lit("") for c in ("reviewer_ok", "reviewer", "note")}
        sinks.write_reviewer_csv(drawn.withColumns(blank), sample, S.SAMPLE.names)
    for name in ("identity_map", "research_ids", "report_ids", "encounter_ids", "date_shifts", "id_merges", "decisions"):
        vault.save(name, t[name])
    summary = run_summary(t["records"], t["inventory"], t["review_pairs"], t["pending"], rows)
    summary |= {"lock_files": locks, "human_sample_rows": src.read_reviewer_csv(spark, str(sample), S.SAMPLE).count(), "seconds": round(time.time() - began, 1)}
    sinks.write_json(summary, d / "run_summary.json")
    vault.log_access("run", reports=summary["reports"], passed=summary["qa_passed"])
    return summary


def release_dataset(spark: SparkSession, cfg: Config) -> dict:
    """Gate, leak scan and the released files; raises ReleaseBlocked."""
    ship(spark)
    vault = Vault(cfg.secure_dir, cfg.key_file)
    path = cfg.secure_dir / "staging_deid.jsonl"
    if not path.exists():
        raise release.ReleaseBlocked("no staged data")
    size = release.gate(src.read_reviewer_csv(spark, str(cfg.secure_dir / "qa_human_sample.csv"), S.SAMPLE))
    all_rows = src.read_jsonl(spark, str(path), S.STAGED)
    passed = Stage(spark, "release").write(release.released_columns(all_rows))
    release.require_no_leak(passed)
    out = cfg.research_dir
    out.mkdir(parents=True, exist_ok=True)
    sinks.write_csv_parts(passed.orderBy("file_index"), str(out / "reports_csv"), S.REPORT_COLUMNS)
    sinks.write_bulk(passed.orderBy("file_index").select(*S.REPORT_COLUMNS), str(out / "reports_jsonl"), "json")
    small = release.small_cells(passed, cfg.k_min)
    for name, df in (("patients", release.patient_rollup(passed)), ("inventory", release.safe_inventory(passed)), ("cohort_summary", release.cohort_summary(passed).orderBy("dimension", "value")), ("small_cells", small)):
        sinks.write_csv_parts(df, str(out / f"{name}_csv"), df.columns)
    manifest = {
        "released_at": datetime.now().isoformat(timespec="seconds"), "n_reports": passed.count(), "n_patients": passed.select("research_patient_id").distinct().count(), "n_blocked_by_qa": all_rows.where("qa_status not like 'passed%'").count(),
        "human_sample_size": size, "k_min": cfg.k_min, "n_small_cells": small.count(), "note": "Merge or suppress the groups of small_cells before publishing.",
    }
    sinks.write_json(manifest, out / "release_manifest.json")
    vault.log_access("release", ok=True)
    return manifest


def dicom_folder(spark: SparkSession, cfg: Config, folder: str, out: str) -> dict[str, DataFrame]:
    """dicom_headers over the files of a folder, and de-identified copies of the linked ones below ``out``."""
    ship(spark)
    headers = Stage(spark, "headers").write(dicom.read_headers(spark, folder))
    got = dicom_headers(spark, cfg, headers, folder, out)
    return got


def dicom_headers(spark: SparkSession, cfg: Config, headers: DataFrame, folder: str | None = None, copies: str | None = None) -> dict[str, DataFrame]:
    """Linked, de-identified and unlinked header rows; saves the image links, and the manifest and the unlinked files as CSV parts
    where there are any. With a folder and a place for copies the files themselves are rewritten."""
    ship(spark)
    vault = Vault(cfg.secure_dir, cfg.key_file)
    identity, shifts = (_load(vault, spark, n) for n in ("identity_map", "date_shifts"))
    linked = Stage(spark, "dicom").write(imaging.nearest_report(headers, identity, key=vault.link_key))
    done = imaging.deidentified_headers(headers, linked, identity, shifts, vault.link_key)
    columns = ["file", "report_uid", "study_id", "needs_pixel_review"]
    if folder and copies:
        who = identity.groupBy("uid").agg(F.min("research_patient_id").alias("research_patient_id"))
        rows = linked.join(who, "uid").join(shifts, "research_patient_id")
        written = Stage(spark, "copies").write(dicom.write_copies(spark, folder, rows, copies, vault.link_key))
        done, columns = done.join(written, "file"), [*columns, "output"]
    links = imaging.image_links(done)
    old = _load(vault, spark, "image_links")
    vault.save("image_links", old.join(links, "uid", "left_anti").unionByName(links))
    vault.log_access("dicom", files=headers.count())
    out = {"manifest": done, "unlinked": imaging.unlinked(headers, linked)}
    for name, df, shown in (("dicom_manifest_csv", done, columns), ("dicom_unlinked_csv", out["unlinked"], ["file", "reason"])):
        if not df.isEmpty():
            sinks.write_csv_parts(df.orderBy("file"), str(cfg.secure_dir / name), shown)
    return out
