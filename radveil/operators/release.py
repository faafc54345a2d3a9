"""Gate, leak scan and the released tables. Rows are released reports; repeated rows are kept unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scrub import pattern_hits
from ..schemas import REPORT_COLUMNS, TEXT_FIELDS
from .qa import body_of

DIMENSIONS = ("modality", "contrast", "sex", "age_band", "body_region")


class ReleaseBlocked(RuntimeError):
    """The gate or the leak scan forbids the release."""


def gate_state(sample: DataFrame) -> DataFrame:
    """(n_rows, n_yes, is_open): open if there are rows and each is marked yes (trimmed, any case)."""
    ok = F.lower(F.trim(F.coalesce("reviewer_ok", F.lit("")))) == "yes"
    return sample.agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("n_yes")).withColumn("is_open", (F.col("n_rows") > 0) & (F.col("n_rows") == F.col("n_yes")))


def gate(sample: DataFrame) -> int:
    """Number of sample rows; raises where the gate is closed."""
    n, good, is_open = gate_state(sample).first()
    if not is_open:
        raise ReleaseBlocked(f"human sample: {n - good} of {n} rows are not marked yes")
    return n


def leak_scan(reports: DataFrame) -> DataFrame:
    """(report_id, leak) with the first identifier pattern found in the joined text fields; reports without a hit are left out."""
    hits = pattern_hits(body_of([F.col(f) for f in TEXT_FIELDS]))
    return reports.select("report_id", F.get(hits, 0).alias("leak")).where("leak is not null").distinct()


def require_no_leak(reports: DataFrame) -> None:
    found = [r.report_id for r in leak_scan(reports).limit(10).collect()]
    if found:
        raise ReleaseBlocked(f"identifier patterns in records, among them {found}")


def patient_rollup(reports: DataFrame, order: str = "file_index") -> DataFrame:
    """Per patient: sex of the first row by ``order`` (staged order: that of the files), reports, age band of the first report,
    follow-up days, modalities. Rows without a place in the order come last."""
    at = F.struct(F.col(order).isNull(), F.col(order), F.col("report_id"))
    first = F.struct(F.col("report_seq"), F.col("report_id"))
    return reports.groupBy("research_patient_id").agg(
        F.min_by("sex", at).alias("sex"),
        F.count("*").alias("n_reports"),
        F.min_by("age_band", first).alias("first_age_band"),
        F.max(F.coalesce("days_since_first_report", F.lit(0))).alias("follow_up_days"),
        F.array_join(F.array_sort(F.collect_set("modality")), ";").alias("modalities"),
    )


def safe_inventory(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", "modality", "contrast", "body_region", "image_available")


def cohort_summary(reports: DataFrame) -> DataFrame:
    """(dimension, value, n_reports): counts per value of five dimensions, empty as 'missing', and empty text fields, zeros too."""
    filled = [F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("missing")).alias(d) for d in DIMENSIONS]
    sets = reports.select(*filled).groupingSets([[d] for d in DIMENSIONS], *DIMENSIONS).agg(F.count("*").alias("n_reports"))
    name = reduce(lambda acc, d: acc.when(F.col(d).isNotNull(), d), DIMENSIONS, F.when(F.lit(False), ""))
    by_value = sets.select(name.alias("dimension"), F.coalesce(*DIMENSIONS).alias("value"), "n_reports")
    empty = reports.agg(*(F.coalesce(F.sum((F.coalesce(F.col(f), F.lit("")) == "").cast("bigint")), F.lit(0)).alias(f) for f in TEXT_FIELDS))
    pairs = F.expr("stack(%d, %s) as (value, n_reports)" % (len(TEXT_FIELDS), ", ".join(f"'{f}', {f}" for f in TEXT_FIELDS)))
    return by_value.unionByName(empty.select(F.lit("empty_field").alias("dimension"), pairs))


def small_cells(reports: DataFrame, k_min: int = 5) -> DataFrame:
    """Cells of sex, age band and modality with fewer than k_min distinct patients; exact, not approximate."""
    cells = reports.groupBy("sex", "age_band", "modality").agg(F.countDistinct("research_patient_id").alias("n_patients"))
    return cells.where(F.col("n_patients") < k_min).orderBy("sex", "age_band", "modality")


def passed(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("qa_status").isin("passed", "passed_override"))


def released_columns(staged: DataFrame) -> DataFrame:
    """The passed rows with the released columns, and file_index, which orders them and isn't released."""
    return passed(staged).select(*REPORT_COLUMNS, "file_index")
