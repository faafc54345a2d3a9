"""The pN_ queries over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, contraction, leakage, mojibake, names, nearest, oddsketch, residue, sanitise, truncation

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "source_files"))


@query()
def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "source_files"))


STRIP = r"nullif(lower(regexp_replace({}, '^[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')), '')"


@query(
    f"""with recursive r as (select {STRIP.format("record_a")} as a0, {STRIP.format("record_b")} as b0, {STRIP.format("string_split(pair_key, '|')[1]")} as k1, {STRIP.format("string_split(pair_key, '|')[2]")} as k2, {STRIP.format("decision")} as d from linkage_review),
    p as (select case when a0 is not null and b0 is not null then a0 else coalesce(k1, a0, b0) end as a, case when a0 is not null and b0 is not null then b0 else coalesce(k2, b0, a0) end as b, coalesce(d = 'same', false) as same from r),
    n as (select a as uid from p where a is not null union select b from p where b is not null),
    e as (select a, b from p where same union select b, a from p where same),
    reach(uid, hop) as (select uid, uid from n union select reach.uid, e.b from reach join e on e.a = reach.hop)
    select uid, min(hop) as group_id from reach group by uid"""
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return contraction.found(table(spark, d, "linkage_review"))


NO = r"nullif(lower(regexp_replace({}, '[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', '', 'g')), '')"


@query(
    f"""with s as (select distinct file, {NO.format("patient_id")} as no, try_strptime(study_date, '%Y%m%d')::date as day from dicom_headers where regexp_full_match(study_date, '[0-9]{{8}}')),
    i as (select distinct uid, {NO.format("id_no")} as no, report_date::date as day from identity_map where report_date is not null)
    select file, uid from (select file, uid, row_number() over (partition by file order by abs(s.day - i.day), uid) as k from s join i using (no) where s.day is not null and abs(s.day - i.day) <= 3) where k = 1"""
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.found(table(spark, d, "dicom_headers"), table(spark, d, "identity_map"))


@query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"))


WORDS = "string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g')), ' ')"


def _linked(words: int, threshold: float) -> str:
    """d(id, cls): reports of 20 words or more with the smallest report of the same words; linked(x, y): classes alike, both ways."""
    text = "coalesce(technique, '') || ' ' || coalesce(findings, '')"
    gram = ", ".join(f"w[i + {k}]" for k in range(words))
    return f"""t as (select distinct report_id as id, {WORDS.format(text)} as w from reports where report_id is not null),
    d as (select id, min(id) over (partition by w) as cls, w from t where len(w) >= 20),
    g as (select distinct cls, [{gram}] as h from (select cls, w, unnest(range(1, len(w) - {words - 2})) as i from d where id = cls)),
    n as (select cls, count(*) as n from g group by cls),
    met as (select a.cls as x, b.cls as y, count(*) as shared from g a join g b on a.h = b.h and a.cls < b.cls group by 1, 2),
    one as (select x, y from met join n a on a.cls = x join n b on b.cls = y where shared >= {threshold} * (a.n + b.n - shared)),
    linked as (select x, y from one union all select y, x from one)"""


@query(
    f"""with {_linked(3, 0.5)}, p as (select id as x, cls as y from d union select d.id, linked.y from d join linked on linked.x = d.cls)
    select distinct least(x, y) as report_a, greatest(x, y) as report_b from p where x <> y"""
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return oddsketch.found(table(spark, d, "reports"))


@query(
    f"""with recursive {_linked(5, 0.8)}, reach(cls, hop) as (select distinct cls, cls from d union select reach.cls, linked.y from reach join linked on linked.x = reach.hop),
    k as (select cls, min(hop) as group_id from reach group by cls), m as (select x as cls, count(*) as n_links from linked group by x)
    select distinct id as report_id, group_id, coalesce(n_links, 0) as n_links from d join k using (cls) left join m using (cls)"""
)
def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return oddsketch.grouped(table(spark, d, "reports"))


LEAKS = f"""with d as (select doc_id, {WORDS.format("text")} as w from documents), i as (select item_id, {WORDS.format("item_text")} as w from eval_items),
    dw as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) as g from d where len(w) >= 10),
    iw as (select distinct item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) as g from i where len(w) >= 10)
    select distinct doc_id, item_id from dw join iw using (g)"""


@query(LEAKS)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query(f"select item_id, count(distinct doc_id) as n_docs from ({LEAKS}) group by item_id")
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.by_item(p9_found(spark, d))


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(table(spark, d, "documents"))


@query()
def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.significant(truncation.hazards(table(spark, d, "documents")))


@query()
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "parse_report"))


@query()
def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return residue.cleaned(table(spark, d, "parse_report"))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sanitise.found(table(spark, d, "reports"), table(spark, d, "identity_map"))


@query()
def p3_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return sanitise.sanitised(table(spark, d, "reports"), table(spark, d, "identity_map"))


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "parse_report"), table(spark, d, "linkage_records"), table(spark, d, "nicknames"))


@query()
def p5_people(spark: SparkSession, d: str) -> DataFrame:
    return names.people(table(spark, d, "parse_report"), table(spark, d, "linkage_records"), table(spark, d, "nicknames"))
