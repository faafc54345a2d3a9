"""Explicit schemas; nothing is inferred. The names and order of columns equal those of the files people work with."""

from pyspark.sql import types as T


def _strings(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


SOURCE_FILES = T.StructType(
    [T.StructField("file_index", T.IntegerType()), *_strings("path rel folder sha256"), T.StructField("size", T.LongType()), T.StructField("is_ole", T.BooleanType()), *_strings("text"), T.StructField("meta", T.MapType(T.StringType(), T.StringType())), *_strings("error")]
)
HEADER_FIELDS = ("id_no", "patient_name", "date", "age", "sex", "examined")
SECTION_FIELDS = ("technique", "clinical_information", "findings", "impression", "advice")
PARSED = T.StructType(
    [
        *_strings("title"),
        T.StructField("header", T.StructType(_strings(" ".join(HEADER_FIELDS)))),
        T.StructField("sections", T.StructType(_strings(" ".join(SECTION_FIELDS)))),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        *_strings("stop_reason"),
    ]
)
TEXT_FIELDS = ("exam", "clinical_information", "technique", "findings", "impression", "advice")
REVIEW = T.StructType(_strings("pair_key reason decision record_a record_b name_a name_b sex_a sex_b age_a age_b date_a date_b id_no_a id_no_b file_a file_b"))
REVIEW_COLUMNS = REVIEW.names
OVERRIDES = T.StructType(_strings("report_id decision reviewer note"))
SAMPLE = T.StructType(_strings("report_id source_file exam clinical_information findings impression advice sex age reviewer_ok reviewer note"))
INVENTORY_COLUMNS = ["file_uid", "status", "folder_date_valid", "size_bytes", "ole_doc", "modality", "contrast", "body_region", "has_image", "meta_has_author", "filename_has_text", "stop_reason", "warnings"]
REPORT_COLUMNS = ["research_patient_id", "encounter_id", "report_id", "study_id", "image_available", "report_seq", "days_since_first_report", "report_date_shifted", "sex", "age", "age_band", "modality", "contrast", "body_region", *TEXT_FIELDS]
STAGED = T.StructType(
    [
        *_strings("research_patient_id encounter_id report_id study_id"),
        T.StructField("image_available", T.BooleanType()),
        T.StructField("report_seq", T.IntegerType()),
        T.StructField("days_since_first_report", T.IntegerType()),
        *_strings("report_date_shifted sex age age_band modality contrast body_region " + " ".join(TEXT_FIELDS) + " qa_status qa_issues"),
        T.StructField("file_index", T.IntegerType()),
    ]
)
