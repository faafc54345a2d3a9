"""Named queries over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import fixed as X
from ..functions import keys as K
from ..functions import layout
from ..functions.scrub import pattern_hits, scrub_fields
from ..operators import imaging, inventory, linkage, qa, release, staging, state
from ..operators.components import connected_components
from ..schemas import SECTION_FIELDS, TEXT_FIELDS
from ..session import Stage, table
from ..sources import files as src
from . import oracles as O
from .pipeline import summary_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- sources and inventory ---------------------------------------------------------------------


@query(
    r"""
    with f as (select *, coalesce(regexp_extract(path, '([^/]*)/*$', 1), '') as nm, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '(.)\.[^.]+$', '\1') as stem from source_files)
    select file_index, lower(nm) similar to '(.|\n)+\.doc' as is_doc, starts_with(nm, '~$') as is_lock,
      case when regexp_full_match(folder, '\d{1,2}-\d{1,2}-\d{4}') then try_strptime(folder, '%d-%m-%Y')::date end as folder_date,
      coalesce(array_to_string(list_transform(regexp_extract_all(coalesce(stem, ''), '[A-Za-z]{2,}'), lambda t: lower(t)), ' '), '') as stem_tokens,
      coalesce(meta['author'], '') <> '' or coalesce(meta['last_saved_by'], '') <> '' as meta_has_author,
      len(regexp_extract_all(coalesce(stem, ''), '[A-Za-z]{2,}')) > 0 as filename_has_text
    from f"""
)
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    return inventory.source_scan(table(spark, d, "source_files"))


@query(
    f"""
    select file_index, {O.hmac("file", "sha256", 20)} as uid,
      case when file_index = min(file_index) over (partition by sha256) then 'first' else 'duplicate_file' end as status
    from (select distinct file_index, sha256 from source_files)"""
)
def file_dedup(spark: SparkSession, d: str) -> DataFrame:
    return inventory.file_uids(table(spark, d, "source_files")).select("file_index", "uid", "status")


@query(O.chain("parsed", "select * from parsed"))
def parse_reports(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files")
    return files.select("file_index", layout.parsed(F.col("text"), F.col("error")).alias("p")).select("file_index", "p.title", "p.header.*", "p.sections.*", F.array_join("p.warnings", ";").alias("warnings"), "p.stop_reason")


@query(
    O.chain(
        "recs",
        f"""select u.uid as file_uid, case when not u.first then 'duplicate_file' when list_contains(string_split(r.warnings, ';'), 'extraction_failed') then 'extraction_failed' else 'parsed' end as status, ({O.FOLDER_DAY}) is not null as folder_date_valid, f.size as size_bytes, f.is_ole as ole_doc,
      r.modality, r.contrast, r.body_region, false as has_image, {O.HAS_AUTHOR} as meta_has_author, len({O.STEM_TOKENS}) > 0 as filename_has_text, r.stop_reason, r.warnings, f.file_index from source_files f join uids u using (file_index) left join recs r using (file_index)""".replace("path, '", "f.path, '").replace("meta[", "f.meta["),
    )
)
def inventory_table(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files")
    return inventory.inventory(files, inventory.records(files))


@query(O.chain("recs", "select uid, file_index, report_date, age, sex, birth_year, id_no, id_hash, name_norm, name_part, n_tokens, modality, contrast, body_region, warnings from recs"))
def record_table(spark: SparkSession, d: str) -> DataFrame:
    got = inventory.records(table(spark, d, "source_files"))
    return got.select("uid", "file_index", "report_date", "age", "sex", "birth_year", "id_no", "id_hash", "name_norm", "name_part", "n_tokens", "cls.*", F.array_join("warnings", ";").alias("warnings"))


@query(
    r"""with w as (select distinct path, string_split(path, '/') as parts from source_files where regexp_matches(path, '(?i)[^/]\.doc$') and not starts_with(string_split(path, '/')[-1], '~$'))
    select path, (row_number() over (order by parts) - 1)::int as file_index from w"""
)
def source_listing(spark: SparkSession, d: str) -> DataFrame:
    """Word files in order of their path components."""
    return src.listed(table(spark, d, "source_files"))


@query(
    r"""with w as (select distinct path, string_split(path, '/') as parts from source_files where regexp_matches(path, '(?i)[^/]\.doc$') and not starts_with(string_split(path, '/')[-1], '~$'))
    select path, (row_number() over (order by parts) - 1)::int as file_index from w order by parts limit 100"""
)
def source_head(spark: SparkSession, d: str) -> DataFrame:
    """The head limit of a run: so many files of the sorted list."""
    return src.listed(table(spark, d, "source_files"), 100)


# --- header fields -----------------------------------------------------------------------------


@query(O.chain("days", "select uid, header_date, day as report_date from parse_report left join days on s = header_date"))
def header_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parse_report").select("uid", "header_date", V.parse_date(F.col("header_date")).alias("report_date"))


@query(f"select uid, {O.age_years('age')} as age_years, {O.age_out(O.age_years('age'))} as age_out, {O.age_band(O.age_years('age'))} as age_band, {O.sex('sex')} as sex_out from parse_report")
def age_and_sex(spark: SparkSession, d: str) -> DataFrame:
    years = V.parse_age_years(F.col("age"))
    return table(spark, d, "parse_report").select("uid", years.alias("age_years"), V.age_text(years).alias("age_out"), V.age_band(years).alias("age_band"), V.parse_sex(F.col("sex")).alias("sex_out"))


@query("select uid, " + ", ".join(f"{v} as {k}" for k, v in O.exam_class("examined", "technique", "title").items()) + " from parse_report")
def exam_classes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parse_report")
    return p.select("uid", V.exam_class(F.col("examined"), F.col("technique"), F.col("title")).alias("c")).select("uid", "c.*")


@query(f"select uid, {O.birth_year('report_date::date', O.age_years('age_raw'))} as birth_year from identity_map")
def birth_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "identity_map").select("uid", V.birth_year(F.col("report_date").cast("date"), V.parse_age_years(F.col("age_raw"))).alias("birth_year"))


@query(f"select uid, {O.id_number('id_no')} as id_no from parse_report")
def id_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parse_report").select("uid", K.id_normalised(F.col("id_no")).alias("id_no"))


# --- identity keys -----------------------------------------------------------------------------


@query(f"select uid, {O.masked('patient_name')} as masked_name, {O.name_norm('patient_name')} as name_norm from parse_report")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("patient_name")
    return table(spark, d, "parse_report").select("uid", K.masked_name(name).alias("masked_name"), K.name_norm(name).alias("name_norm"))


@query(
    """with l as (select uid, regexp_replace(lower(coalesce(patient_name, '')), '[^a-z]', '', 'g') as w from parse_report),
    c as (select uid, w, translate(left(w, 1) || regexp_replace(substr(w, 2), '[hw]', '', 'g'), 'bfpvcgjkqsxzdtlmnr', '111122222222334556') as x from l),
    o as (select uid, w, array_to_string(list_transform(list_filter(range(2, length(x) + 1), lambda i: substr(x, i, 1) <> substr(x, i - 1, 1) and substr(x, i, 1) between '1' and '6'), lambda i: substr(x, i, 1)), '') as digits from c)
    select uid, case when w = '' then 'NA' else left(upper(left(w, 1)) || digits || '000', 4) end as soundex from o"""
)
def name_soundex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parse_report").select("uid", K.soundex(F.col("patient_name")).alias("soundex"))


@query(
    f"""
    with l as (select uid, min(sex) as sex, min(birth_year) as birth_year from linkage_records group by uid),
    p as (select p.uid, {O.masked("patient_name")} as m, {O.year_bin("birth_year")} as bin, sex from (select distinct uid, patient_name from parse_report) p join l using (uid))
    select uid, m as masked_name, upper({O.hmac("ksrl:name", "m", 32)} || {O.hmac("ksrl:demo", "(sex || bin)", 32)} || {O.hmac("ksrl:addr", "'NA'", 32)}) as pik,
      len(list_filter(string_split(m, ' '), lambda t: t <> ''))::int as n_tokens from p"""
)
def patient_keys(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "linkage_records").groupBy("uid").agg(F.min("sex").alias("sex"), F.min("birth_year").alias("birth_year"))
    got = table(spark, d, "parse_report").select("uid", "patient_name").distinct().join(known, "uid")
    return got.select("uid", K.pik(F.col("patient_name"), F.col("sex"), F.col("birth_year")).alias("k")).select("uid", "k.masked_name", "k.pik", "k.n_tokens")


# --- linkage -----------------------------------------------------------------------------------

@query(O.chain("clusters", "select a, b, reason, action from pass1"))
def link_same_name(spark: SparkSession, d: str) -> DataFrame:
    return linkage.same_name_pairs(table(spark, d, "linkage_records"))


@query(f"with r as {O.RECS} select distinct a.uid as a, b.uid as b, 'same_id_no_different_identity' as reason from r a join r b on a.id_hash = b.id_hash and a.uid < b.uid where a.name_part is distinct from b.name_part or a.sex is distinct from b.sex")
def link_same_id(spark: SparkSession, d: str) -> DataFrame:
    return linkage.same_id_pairs(table(spark, d, "linkage_records"))


@query(O.chain("similar", "select * from similar_v"))
def link_similar_names(spark: SparkSession, d: str) -> DataFrame:
    return linkage.similar_names(table(spark, d, "linkage_records"))


@query(O.chain("clusters", "select uid, root from roots"))
def link_clusters(spark: SparkSession, d: str) -> DataFrame:
    recs = table(spark, d, "linkage_records")
    return linkage.clusters_of(recs, linkage.merge_edges(recs))


@query(O.chain("review", "select a, b, reason from review"))
def link_review_pairs(spark: SparkSession, d: str) -> DataFrame:
    return linkage.review_queue(table(spark, d, "linkage_records"))[0]


@query("select pair_key, max(lower(trim(coalesce(decision, '')))) as decision from linkage_review where pair_key is not null group by pair_key")
def link_decisions(spark: SparkSession, d: str) -> DataFrame:
    return linkage.normalised_decisions(table(spark, d, "linkage_review"))


@query(O.chain("pending", "select uid from pending"))
def link_pending(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d)


@query(
    O.chain(
        "pending",
        "select pair_key, reason, coalesce(decision, '') as decision, a as record_a, b as record_b, x.patient_name as name_a, y.patient_name as name_b, x.sex as sex_a, y.sex as sex_b, x.age_raw as age_a, y.age_raw as age_b, x.report_date as date_a, y.report_date as date_b, x.id_no as id_no_a, y.id_no as id_no_b, x.source as file_a, y.source as file_b from keyed join (select distinct * from identity_map) x on x.uid = a join (select distinct * from identity_map) y on y.uid = b",
    )
)
def link_review_file(spark: SparkSession, d: str) -> DataFrame:
    review, _ = linkage.review_queue(table(spark, d, "linkage_records"))
    identity = table(spark, d, "identity_map").dropDuplicates(["uid"])
    return linkage.review_rows(review, linkage.normalised_decisions(table(spark, d, "linkage_review")), identity)


@query(
    O.chain(
        "clusters",
        "select uid, coalesce(rid, 'RP-' || upper(substr(sha256(root), 1, 10))) as research_patient_id from roots join kept using (root)",
        "old as (select uid, min(research_patient_id) as rid from identity_map group by uid)",
        "kept as (select root, min(rid) as rid from roots left join old using (uid) group by root)",
    )
)
def research_ids(spark: SparkSession, d: str) -> DataFrame:
    recs = table(spark, d, "linkage_records")
    old = table(spark, d, "identity_map").groupBy("uid").agg(F.min("research_patient_id").alias("research_patient_id"))
    return linkage.assign_research_ids(linkage.clusters_of(recs, linkage.merge_edges(recs)), old, linkage.keyed_ids)[0]


@query(
    O.chain(
        "clusters",
        "select distinct old.rid as retired, kept.rid as into from roots join old using (uid) join kept using (root) where old.rid <> kept.rid union select 'RP-0000000000', 'RP-0000000001'",
        "old as (select distinct uid, research_patient_id as rid from identity_map where research_patient_id is not null)",
        "kept as (select root, min(rid) as rid from roots join old using (uid) group by root)",
    )
)
def merge_log(spark: SparkSession, d: str) -> DataFrame:
    """The log with this run's retired ids; an earlier entry stays."""
    recs, old = table(spark, d, "linkage_records"), table(spark, d, "identity_map").select("uid", "research_patient_id").where("research_patient_id is not null").distinct()
    earlier = spark.createDataFrame([("RP-0000000000", "RP-0000000001")], "retired string, into string")
    return state.append_log(earlier, linkage.assign_research_ids(linkage.clusters_of(recs, linkage.merge_edges(recs)), old, linkage.keyed_ids)[1])


@query(
    """with old as (select uid, min(report_id) as report_id from identity_map where right(uid, 1) between '0' and '7' group by uid)
    select uid, report_id from old union select uid, 'RR-' || upper(substr(sha256(uid), 1, 10)) from linkage_records where uid not in (select uid from old)"""
)
def report_ids(spark: SparkSession, d: str) -> DataFrame:
    """Set if absent: ids of an earlier run (here of part of the records) stay, others get new ones."""
    old = table(spark, d, "identity_map").where("right(uid, 1) between '0' and '7'").groupBy("uid").agg(F.min("report_id").alias("report_id"))
    return state.set_if_absent(old, table(spark, d, "linkage_records"), "uid", lambda new: linkage.keyed_ids(new, "RR", "report_id", "uid"))


@query(
    O.chain(
        "recs",
        f"""select uid, rel as source, id_no, patient_name, sex, age_raw, strftime(report_date, '%Y-%m-%d') as report_date, upper(name_part || demo_part || {O.hmac("ksrl:addr", "'NA'", 32)}) as pik, masked_name,
      'RP-' || upper(substr(sha256(uid), 1, 10)) as research_patient_id, 'RR-' || upper(substr(sha256(uid), 1, 10)) as report_id, 'EN-' || upper(substr(sha256(uid), 1, 10)) as encounter_id from recs""",
    )
)
def identity_rows(spark: SparkSession, d: str) -> DataFrame:
    """The identity map of the parsed files; ids from the uid."""
    recs = inventory.records(table(spark, d, "source_files"))
    made = [linkage.keyed_ids(recs.select("uid"), prefix, column, "uid") for prefix, column in (("RP", "research_patient_id"), ("RR", "report_id"), ("EN", "encounter_id"))]
    return staging.identity_map(recs, *made)


@query(
    """with recursive e as (select research_patient_id as p, id_no as n from identity_map where id_no is not null), reach(p, hop) as (select distinct p, p from e union select reach.p, b.p from reach join e a on a.p = reach.hop join e b on b.n = a.n)
    select p as node, min(hop) as root from reach group by p"""
)
def patient_components(spark: SparkSession, d: str) -> DataFrame:
    """Patients joined by a shared number: each hangs on the number's smallest patient, so edges stay linear."""
    rows = table(spark, d, "identity_map").where("id_no is not null").select("id_no", "research_patient_id").distinct()
    heads = rows.groupBy("id_no").agg(F.min("research_patient_id").alias("head"))
    return connected_components(rows.join(heads, "id_no"), "research_patient_id", "head")


# --- sequence, dates, state --------------------------------------------------------------------


@query(
    """with i as (select distinct uid, research_patient_id, report_id, report_date::date as day from identity_map)
    select uid, research_patient_id, row_number() over (partition by research_patient_id order by day asc nulls last, report_id)::int as report_seq, (day - min(day) over (partition by research_patient_id))::int as days_since_first_report from i"""
)
def patient_sequence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "identity_map").select("uid", "research_patient_id", "report_id", F.col("report_date").cast("date").alias("day")).distinct()
    return inventory.patient_sequence(rows, "research_patient_id", "day", "report_id").select("uid", "research_patient_id", "report_seq", "days_since_first_report")


@query(f"select distinct uid, research_patient_id, strftime(report_date::date + s, '%Y-%m-%d') as report_date_shifted from identity_map join {O.SHIFTS} on p = research_patient_id")
def shifted_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "identity_map").select("uid", "research_patient_id", "report_date").distinct()
    none = spark.createDataFrame([], "research_patient_id string, shift_days int")
    shifts = state.set_if_absent(none, rows, "research_patient_id", state.keyed_shifts(365, "research_patient_id"))
    return rows.join(shifts, "research_patient_id").select("uid", "research_patient_id", V.shifted(F.col("report_date").cast("date"), F.col("shift_days")).alias("report_date_shifted"))


# --- vocabulary and terms ----------------------------------------------------------------------

def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parse_report").select("uid", F.concat_ws("\n", *(F.nullif(F.col(f), F.lit("")) for f in SECTION_FIELDS)).alias("body")).distinct()


@query(O.chain("terms", "select word, n_docs from vocab"))
def clinical_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return qa.vocabulary(_bodies(spark, d), "body")


@query(O.chain("terms", "select word from others"))
def other_name_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _others(spark, d)


def _others(spark: SparkSession, d: str) -> DataFrame:
    stems = table(spark, d, "source_files").select(F.array_join(V.filename_tokens(F.col("path")), " ").alias("name"))
    names = table(spark, d, "parse_report").select(F.col("patient_name").alias("name")).unionByName(stems)
    return qa.other_names(names, "name", qa.vocabulary(_bodies(spark, d), "body"))


def _parsed_once(spark: SparkSession, d: str) -> DataFrame:
    """A row per uid: that of its first file."""
    p = table(spark, d, "parse_report")
    return p.groupBy("uid").agg(F.min_by(F.struct(*p.columns), "file_index").alias("p")).select("p.*")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "identity_map").groupBy("uid").agg(F.min(F.struct("report_id", "id_no", "research_patient_id", "patient_name")).alias("i")).select("uid", "i.*")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").select("file_index", "path", "meta")
    rows = _parsed_once(spark, d).select("uid", "file_index", "patient_name").join(files, "file_index")
    rows = rows.withColumn("stem_tokens", V.filename_tokens(F.col("path")))
    return qa.term_sets(rows, qa.vocabulary(_bodies(spark, d), "body"), "uid", "patient_name", "stem_tokens", "meta")


@query(O.chain("terms", "select uid, array_to_string(own, ' ') as own, array_to_string(staff, ' ') as staff from terms"))
def term_sets(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("uid", F.array_join("own", " ").alias("own"), F.array_join("staff", " ").alias("staff"))


# --- scrubbing and checks ----------------------------------------------------------------------


def _staged(spark: SparkSession, d: str) -> DataFrame:
    ids = _ids(spark, d).drop("patient_name")
    shifts = state.keyed_shifts(365, "research_patient_id")(ids.select("research_patient_id").distinct())
    rows = _parsed_once(spark, d).drop("id_no").join(ids, "uid").join(shifts, "research_patient_id").join(_terms(spark, d), "uid")
    rows = rows.withColumn("sources", F.array(*(F.col("examined" if f == "exam" else f) for f in TEXT_FIELDS)))
    rows = scrub_fields(rows, "sources", "own", "id_no", "shift_days")
    return rows.withColumns({f: F.get("scrubbed", k) for k, f in enumerate(TEXT_FIELDS)})


@query(O.chain("scrub", f"select uid, {', '.join(TEXT_FIELDS)}, counts from scrubbed"))
def scrub_reports(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d).select("uid", *TEXT_FIELDS, F.to_json("scrub_counts").alias("counts"))


@query(O.chain("scrub_r", f"select uid as report_id, {', '.join(TEXT_FIELDS)}, counts from scrubbed"))
def scrub_released(spark: SparkSession, d: str) -> DataFrame:
    """What the earlier scrub missed in released texts: all steps, with the patient's own names and number."""
    ids = _ids(spark, d).select("report_id", "id_no", K.significant_tokens(F.col("patient_name")).alias("own"))
    rows = table(spark, d, "reports").distinct().join(ids, "report_id")
    rows = rows.join(state.keyed_shifts(365, "research_patient_id")(rows.select("research_patient_id").distinct()), "research_patient_id")
    rows = scrub_fields(rows.withColumn("sources", F.array(*TEXT_FIELDS)), "sources", "own", "id_no", "shift_days")
    return rows.select("report_id", *(F.get("scrubbed", k).alias(f) for k, f in enumerate(TEXT_FIELDS)), F.to_json("scrub_counts").alias("counts"))


@query(O.chain("scrub_d", "select uid as doc_id, text, counts from scrubbed"))
def scrub_documents(spark: SparkSession, d: str) -> DataFrame:
    """All steps over texts of four languages; terms and number are made up from other columns."""
    rows = table(spark, d, "documents").withColumns({"sources": F.array("text"), "own": F.array(F.lit("report"), F.lit("seen"), F.coalesce(F.lower("modality"), F.lit(""))), "days": (F.col("doc_id") % 700 - 350).cast("int")})
    return scrub_fields(rows, "sources", "own", "facility_id", "days").select("doc_id", F.get("scrubbed", 0).alias("text"), F.to_json("scrub_counts").alias("counts"))


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(review pairs, pending uids)."""
    recs = table(spark, d, "linkage_records")
    review, base = linkage.review_queue(recs)
    return review, linkage.apply_decisions(recs, review, base, linkage.normalised_decisions(table(spark, d, "linkage_review")))[1]


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[1]


def _overrides(spark: SparkSession, d: str) -> DataFrame:
    """A reviewer's answers, made up from the last sign of the report's id, for the tables hold none."""
    last = F.right("report_id", F.lit(1))
    return _ids(spark, d).select("report_id", F.when(last == O.PASS_LAST, " Pass ").when(last == O.FAIL_LAST, "FAIL").when(last == O.OTHER_LAST, "later").otherwise("").alias("decision"))


def _checked(spark: SparkSession, d: str, pending: DataFrame | None = None) -> DataFrame:
    pending = _pending(spark, d) if pending is None else pending
    rows = _staged(spark, d).join(pending.withColumn("pending", F.lit(True)), "uid", "left")
    rows = qa.record_issues(rows, _others(spark, d)).join(_overrides(spark, d).withColumn("decision", F.lower(F.trim("decision"))), "report_id", "left")
    return rows.withColumn("qa_status", qa.status(F.col("decision"), F.col("issues")))


@query(O.chain("qa", "select uid, report_id, case when len(mine) > 0 then 'failed' else 'passed' end as qa_status, array_to_string(mine, ';') as issues from (select *, list_filter(issues, lambda x: x <> 'linkage_pending_review') as mine from checked)"))
def qa_issues(spark: SparkSession, d: str) -> DataFrame:
    """The checks of each record where linkage under review doesn't hold records back, before anyone overrides them."""
    rows = qa.record_issues(_staged(spark, d).withColumn("pending", F.lit(False)), _others(spark, d))
    return rows.select("uid", "report_id", qa.status(F.lit(None).cast("string"), F.col("issues")).alias("qa_status"), F.array_join("issues", ";").alias("issues"))


@query(O.chain("qa", "select uid, report_id, decision, qa_status, array_to_string(issues, ';') as issues from checked"))
def qa_status(spark: SparkSession, d: str) -> DataFrame:
    """The gate: records under linkage review are held back, and a reviewer's overrides count."""
    return _checked(spark, d).select("uid", "report_id", "decision", "qa_status", F.array_join("issues", ";").alias("issues"))


@query(O.chain("qa", "select issue, count(*) as n from (select split_part(unnest(issues), ':', 1) as issue from checked) group by issue"))
def qa_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return qa.issue_counts(_checked(spark, d))


@query(O.chain("qa", "select report_id, source as source_file, qa_status, array_to_string(issues, ';') as issues from checked join (select distinct report_id, source from identity_map) using (report_id) where len(issues) > 0 or decision <> ''"))
def qa_issue_rows(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "identity_map").select("report_id", F.col("source").alias("source_file")).distinct()
    return staging.issue_rows(_checked(spark, d).withColumn("qa_issues", F.array_join("issues", ";")).join(source, "report_id"))


@query(O.chain("qa", f"select report_id, qa_status, {', '.join(TEXT_FIELDS)} from checked where qa_status <> 'failed'"))
def released_rows(spark: SparkSession, d: str) -> DataFrame:
    """What passes the gate, by check or by override."""
    return release.passed(_checked(spark, d)).select("report_id", "qa_status", *TEXT_FIELDS)


def _run_figures() -> str:
    n = lambda key, value: f"select '{key}' as figure, '' as value, ({value}) as n"
    per = lambda key, value, source: f"select '{key}' as figure, {value} as value, count(*) as n from {source} group by 2"
    return " union all ".join(
        [
            n("reports", "select count(*) from recs"),
            n("duplicate_files", "select count(*) from uids where not first"),
            n("patients", "select count(distinct research_patient_id) from checked_ids"),
            n("patients_with_multiple_reports", "select count(*) from (select 1 from checked_ids group by research_patient_id having count(*) > 1)"),
            per("parse_warnings", "w", "(select unnest(string_split(warnings, ';')) as w from recs) where w <> ''").replace("group by 2", "group by w"),
            per("stop_reasons", "stop_reason", "recs"),
            per("modality", "modality", "recs"),
            per("linkage_review_pairs", "reason", "review"),
            n("linkage_review_undecided_records", "select count(*) from pending"),
            n("qa_passed", "select count(*) from checked where qa_status <> 'failed'"),
            n("qa_failed", "select count(*) from checked where qa_status = 'failed'"),
            "select 'qa_issue_counts' as figure, issue as value, count(*) as n from (select split_part(unnest(issues), ':', 1) as issue from checked) group by issue",
        ]
    )


@query(O.chain("recs qa", _run_figures(), "checked_ids as (select uid, research_patient_id from checked join ids using (uid))"))
def run_figures(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a run's summary, one row each. Each table that several of them count is made once."""
    files, stage = table(spark, d, "source_files"), Stage(spark, "figures")
    recs = stage.write(inventory.records(files))
    review, pending = _decided(spark, d)
    pending = stage.write(pending)
    rows = stage.write(_checked(spark, d, pending).select("research_patient_id", "qa_status", "issues"))
    return summary_rows(recs, inventory.inventory(files, recs), review, pending, rows)


R_BODY = " || chr(10) || ".join(f"coalesce({f}, '')" for f in TEXT_FIELDS)
HITS = O.pattern_hits("body")


@query(f"select distinct report_id, array_to_string({HITS}, ';') as hits from (select report_id, {R_BODY} as body from reports)")
def qa_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "reports").select("report_id", qa.body_of([F.col(f) for f in TEXT_FIELDS]).alias("body"))
    return rows.select("report_id", F.array_join(pattern_hits(F.col("body")), ";").alias("hits")).distinct()


@query(f"select distinct report_id, hits[1] as leak from (select report_id, {HITS} as hits from (select report_id, {R_BODY} as body from reports)) where len(hits) > 0")
def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    return release.leak_scan(table(spark, d, "reports"))


@query("select count(distinct report_id) as n, least(count(distinct report_id), greatest(30, round_even(count(distinct report_id) * 0.05::double, 0)))::int as sample_size from reports")
def sample_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").agg(F.countDistinct("report_id").alias("n")).select("n", qa.sample_size(F.col("n")).alias("sample_size"))


@query("""with r as (select distinct report_id from reports), n as (select count(*) as n from r)
    select report_id from (select report_id, row_number() over (order by sha256('seed' || report_id), report_id) as k from r), n where k <= least(n, greatest(30, round_even(n * 0.05::double, 0)))""")
def human_sample(spark: SparkSession, d: str) -> DataFrame:
    return qa.human_sample(table(spark, d, "reports").select("report_id").distinct(), "report_id", seed="seed")


# --- release -----------------------------------------------------------------------------------

REPORTS = "(select distinct * from reports)"


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").distinct()


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Released rows with the place of their file, which is the staged order."""
    files = table(spark, d, "parse_report").groupBy("uid").agg(F.min("file_index").alias("file_index"))
    return _reports(spark, d).join(_ids(spark, d).select("report_id", "uid"), "report_id", "left").join(files, "uid", "left").drop("uid")


@query(
    f"""with f as (select r.*, p.file_index from {REPORTS} r left join (select report_id, min(uid) as uid from identity_map group by report_id) using (report_id) left join (select uid, min(file_index) as file_index from parse_report group by uid) p using (uid)),
    k as (select *, row_number() over (partition by research_patient_id order by file_index nulls last, report_id) as place, row_number() over (partition by research_patient_id order by report_seq, report_id) as visit from f)
    select research_patient_id, max(sex) filter (place = 1) as sex, count(*) as n_reports, max(age_band) filter (visit = 1) as first_age_band,
      max(coalesce(days_since_first_report, 0)) as follow_up_days, string_agg(distinct modality, ';' order by modality) as modalities
    from k group by research_patient_id"""
)
def patient_rollup(spark: SparkSession, d: str) -> DataFrame:
    return release.patient_rollup(_placed(spark, d))


@query("select count(*) as n_rows, count(*) filter (a = 'yes') as n_yes, count(*) > 0 and count(*) = count(*) filter (a = 'yes') as is_open from (select lower(trim(coalesce(decision, ''))) as a from linkage_review)")
def release_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate over a review's typed answers: closed unless each is yes."""
    return release.gate_state(table(spark, d, "linkage_review").select(F.col("decision").alias("reviewer_ok")))


@query(f"select report_id, modality, contrast, body_region, image_available from {REPORTS}")
def safe_inventory(spark: SparkSession, d: str) -> DataFrame:
    return release.safe_inventory(_reports(spark, d))


@query(
    " union all ".join(f"select '{x}' as dimension, coalesce(nullif({x}, ''), 'missing') as value, count(*) as n_reports from {REPORTS} group by 2" for x in release.DIMENSIONS)
    + "".join(f" union all select 'empty_field', '{f}', count(*) filter (coalesce({f}, '') = '') from {REPORTS}" for f in TEXT_FIELDS)
)
def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    return release.cohort_summary(_reports(spark, d))


@query("select sex, age_band, modality, count(distinct research_patient_id) as n_patients from reports group by sex, age_band, modality having count(distinct research_patient_id) < 5")
def small_cells(spark: SparkSession, d: str) -> DataFrame:
    return release.small_cells(table(spark, d, "reports"))


@query("select count(distinct research_patient_id) as n_patients, count(distinct report_id) as n_reports, (select count(*) from (select research_patient_id from reports group by 1 having count(distinct report_id) > 1)) as patients_with_multiple_reports from reports")
def release_counts(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "reports").groupBy("research_patient_id").agg(F.countDistinct("report_id").alias("n"))
    return per.agg(F.count("*").alias("n_patients"), F.sum("n").alias("n_reports"), F.sum((F.col("n") > 1).cast("bigint")).alias("patients_with_multiple_reports"))


# --- imaging -----------------------------------------------------------------------------------

@query(O.chain("imaging", "select file, uid, distance from linked"))
def dicom_nearest_report(spark: SparkSession, d: str) -> DataFrame:
    return imaging.nearest_report(table(spark, d, "dicom_headers"), table(spark, d, "identity_map"))


@query(O.chain("imaging", "select distinct file, 'no report with matching ID NO within 3 days' as reason from dicom_headers where file not in (select file from linked)"))
def dicom_unlinked(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "dicom_headers")
    return imaging.unlinked(h, imaging.nearest_report(h, table(spark, d, "identity_map")))


@query(
    f"""select distinct file, upper(coalesce(tags['BurnedInAnnotation'], '')) = 'YES' or coalesce(tags['Modality'] in ({", ".join(f"'{m}'" for m in X.PIXEL_RISK_MODALITIES)}), false)
      or contains(upper(coalesce(tags['ImageType'], '')), 'SECONDARY') or contains(upper(coalesce(tags['ImageType'], '')), 'SCREEN') as needs_pixel_review from dicom_headers"""
)
def dicom_pixel_review(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dicom_headers").select("file", imaging.needs_pixel_review().alias("needs_pixel_review")).distinct()


def _deidentified(spark: SparkSession, d: str) -> DataFrame:
    h, i = table(spark, d, "dicom_headers"), table(spark, d, "identity_map")
    shifts = state.keyed_shifts(365, "research_patient_id")(i.select("research_patient_id").distinct())
    return imaging.deidentified_headers(h, imaging.nearest_report(h, i), i, shifts)


@query(O.chain("imaging", "select file, report_uid, study_id, needs_pixel_review, tags from dicom"))
def dicom_deidentified(spark: SparkSession, d: str) -> DataFrame:
    """Tags as sorted lines."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter("tags", lambda k, v: v.isNotNull())), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")
    return _deidentified(spark, d).select("file", "report_uid", "study_id", "needs_pixel_review", lines.alias("tags"))


@query(O.chain("imaging", "select report_uid as uid, arg_max(study_id, file) as study_id from dicom group by report_uid"))
def dicom_image_links(spark: SparkSession, d: str) -> DataFrame:
    return imaging.image_links(_deidentified(spark, d))


@query(O.chain("imaging", "select i.uid, coalesce(study_id, '') as study_id, study_id is not null as image_available from (select distinct uid from identity_map) i left join (select report_uid as uid, arg_max(study_id, file) as study_id from dicom group by report_uid) using (uid)"))
def image_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The study of each record, as the staged table has it."""
    return staging.with_images(table(spark, d, "identity_map").select("uid").distinct(), imaging.image_links(_deidentified(spark, d)))
