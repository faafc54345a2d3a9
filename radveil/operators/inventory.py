"""Source inventory, content dedup and the record table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import keys as K
from ..functions import layout


def source_scan(files: DataFrame) -> DataFrame:
    """Per source file: is it a Word file, a lock file, its folder date, stem tokens and flags.

    Null path: no Word file, no tokens. Null meta: no author. Rows stay as they are, repeats too.
    """
    name = F.coalesce(F.regexp_extract("path", r"([^/]*)/*$", 1), F.lit(""))
    has = lambda k: F.coalesce(F.element_at("meta", k), F.lit("")) != ""
    return files.select(
        "file_index",
        F.lower(name).rlike(r".\.doc$").alias("is_doc"),
        name.startswith("~$").alias("is_lock"),
        V.folder_date(F.col("folder")).alias("folder_date"),
        F.array_join(V.filename_tokens(F.col("path")), " ").alias("stem_tokens"),
        F.coalesce(has("author") | has("last_saved_by"), F.lit(False)).alias("meta_has_author"),
        (F.size(V.filename_tokens(F.col("path"))) > 0).alias("filename_has_text"),
    )


def file_uids(files: DataFrame, key: K.LinkKey = K.PUBLIC_TEST_KEY) -> DataFrame:
    """Adds uid (from the content hash), and status 'first' or 'duplicate_file' by file_index.

    Files of null hash get a null uid and count as copies of each other. Of repeated rows of one file_index one stays.
    """
    once = files.dropDuplicates(["file_index"])
    uid = K.keyed_hash(F.col("sha256"), "file", key, 20)
    # the first file of each content: aggregated before the shuffle, so that a hot content is no hot partition
    firsts = once.groupBy("sha256").agg(F.min("file_index").alias("__first"))
    joined = once.join(firsts, once["sha256"].eqNullSafe(firsts["sha256"])).drop(firsts["sha256"])
    return joined.withColumn("uid", uid).withColumn("status", F.when(F.col("file_index") == F.col("__first"), "first").otherwise("duplicate_file")).drop("__first")


def records(files: DataFrame, key: K.LinkKey = K.PUBLIC_TEST_KEY) -> DataFrame:
    """One row per distinct content: the parsed report with its normalised fields, keys and warnings."""
    first = file_uids(files, key).where("status = 'first'")
    got = first.withColumn("parsed", layout.parsed(F.col("text"), F.col("error")))
    h = lambda c: F.col(f"parsed.header.{c}")
    got = got.withColumns({"__folder": V.folder_date(F.col("folder")), "__header": V.parse_date(h("date")), "age": V.parse_age_years(h("age")), "sex": V.parse_sex(h("sex"))})
    got = got.withColumn("report_date", F.coalesce("__header", "__folder"))
    got = got.withColumn("birth_year", V.birth_year(F.col("report_date"), F.col("age")))
    extra = F.array_compact(
        F.array(
            F.when(F.col("__header").isNull(), "header_date_unparsed").when(F.abs(F.datediff("__header", "__folder")) > 7, "header_date_differs_from_folder"),
            F.when(F.col("age").isNull(), "age_unparsed"),
        )
    )
    got = got.withColumns({"warnings": F.concat("parsed.warnings", extra), "id_no": K.id_normalised(h("id_no")), "pik": K.pik(h("patient_name"), F.col("sex"), F.col("birth_year"), key)})
    return got.select(
        "uid", "file_index", "path", "rel", "folder", "size", "is_ole", "meta", "parsed", "warnings", "report_date", "age", "sex", "birth_year", "pik", "id_no",
        K.keyed_hash(F.col("id_no"), "idno", key).alias("id_hash"),
        K.name_norm(h("patient_name")).alias("name_norm"),
        F.col("pik.name_part").alias("name_part"),
        F.col("pik.n_tokens").alias("n_tokens"),
        V.exam_class(h("examined"), F.col("parsed.sections.technique"), F.col("parsed.title")).alias("cls"),
    )


def inventory(files: DataFrame, recs: DataFrame, key: K.LinkKey = K.PUBLIC_TEST_KEY) -> DataFrame:
    """The 13 inventory columns for every file; class columns are null for duplicates."""
    scan = source_scan(files.dropDuplicates(["file_index"])).select("file_index", "folder_date", "meta_has_author", "filename_has_text")
    base = file_uids(files, key).join(scan, "file_index")
    parsed = recs.select("file_index", "cls.*", F.col("parsed.stop_reason").alias("stop_reason"), F.array_join("warnings", ";").alias("warnings"), F.array_contains("warnings", "extraction_failed").alias("__bad"))
    both = base.join(parsed, "file_index", "left")
    return both.select(
        F.col("uid").alias("file_uid"),
        F.when(F.col("status") == "duplicate_file", "duplicate_file").when(F.col("__bad"), "extraction_failed").otherwise("parsed").alias("status"),
        F.col("folder_date").isNotNull().alias("folder_date_valid"),
        F.col("size").alias("size_bytes"),
        F.col("is_ole").alias("ole_doc"),
        "modality", "contrast", "body_region", F.lit(False).alias("has_image"), "meta_has_author", "filename_has_text", "stop_reason", "warnings", "file_index",
    )


def patient_sequence(df: DataFrame, patient: str, date: str, tie: str) -> DataFrame:
    """Adds report_seq (dates ascending, nulls last, then ``tie``), the patient's first date and the days since it."""
    order = W.partitionBy(patient).orderBy(F.col(date).asc_nulls_last(), F.col(tie))
    out = df.withColumns({"report_seq": F.row_number().over(order).cast("int"), "first_date": F.min(date).over(W.partitionBy(patient))})
    return out.withColumn("days_since_first_report", F.datediff(date, "first_date"))
