"""Vocabulary, name deny-list, record checks, status, sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import keys as K
from ..functions.scrub import own_id_pattern, pattern_hits
from ..session import Stage
from .ranking import numbered

WORD = "[a-z]{2,}"


def words(text: Column) -> Column:
    """Runs of two or more letters a-z of the lower-cased text; empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def vocabulary(bodies: DataFrame, text: str, min_docs: int = X.VOCABULARY_MIN_DOCS) -> DataFrame:
    """(word, n_docs) of words in at least min_docs rows. Counted map-side first; every row counts."""
    each = bodies.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def other_names(names: DataFrame, name: str, vocab: DataFrame) -> DataFrame:
    """Distinct tokens of four letters or more of the names that are no vocabulary, honorific or stop word."""
    toks = names.select(F.explode(words(F.col(name))).alias("word")).where(F.length("word") >= 4).distinct()
    return toks.where(~F.col("word").isin(*X.TITLES, *X.STOP_WORDS)).join(vocab.select("word"), "word", "left_anti")


def term_sets(rows: DataFrame, vocab: DataFrame, uid: str, name: str, stem_tokens: str, meta: str) -> DataFrame:
    """(uid, own, staff): own terms are name tokens (never filtered) and stem tokens without vocabulary, 'doc' and 'copy';
    staff terms are metadata tokens of three letters or more without vocabulary. Sorted arrays; empty where there are none."""
    values = F.array_join(F.map_values(F.coalesce(F.col(meta), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), " ")
    tokens = rows.select(
        uid,
        F.explode(
            F.concat(
                F.transform(K.significant_tokens(F.col(name)), lambda t: F.struct(F.lit("name").alias("kind"), t.alias("word"))),
                F.transform(F.filter(F.col(stem_tokens), lambda t: ~t.isin("doc", "copy")), lambda t: F.struct(F.lit("stem").alias("kind"), t.alias("word"))),
                F.transform(F.regexp_extract_all(values, F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda t: F.struct(F.lit("staff").alias("kind"), F.lower(t).alias("word"))),
            )
        ).alias("t"),
    ).select(uid, "t.kind", "t.word")
    kept = tokens.distinct().join(vocab.select("word", F.lit(True).alias("known")), "word", "left").where("kind = 'name' or known is null")
    sets = kept.groupBy(uid).agg(*(F.array_sort(F.collect_set(F.when(c, F.col("word")))).alias(n) for n, c in (("own", F.col("kind") != "staff"), ("staff", F.col("kind") == "staff"))))
    none = F.array().cast("array<string>")
    return rows.select(uid).distinct().join(sets, uid, "left").select(uid, F.coalesce("own", none).alias("own"), F.coalesce("staff", none).alias("staff"))


def body_of(fields: list[Column]) -> Column:
    """The fields, null as empty, with line breaks between."""
    return F.concat_ws("\n", *(F.coalesce(f, F.lit("")) for f in fields))


def record_issues(df: DataFrame, vocab_names: DataFrame, block_pending: bool = True) -> DataFrame:
    """Adds 'issues' (array, fixed order) to staged rows.

    df: the six text fields, own, staff, id_no, scrub_counts, warnings, pending, uid. ``vocab_names``: other_names().
    The words of a record that are other people's names come from a join on the word, not from a collected list.
    """
    body = body_of([F.col(c) for c in X_FIELDS])
    # written once: both the search for foreign words and the checks read it
    df = Stage(df.sparkSession, "checks").write(df.withColumn("__body", body).withColumn("__words", F.array_distinct(words(F.col("__body")))))
    foreign = df.select("uid", F.explode("__words").alias("word")).join(vocab_names, "word", "left_semi").groupBy("uid").agg(F.collect_set("word").alias("__foreign"))
    df = df.join(foreign, "uid", "left")
    listed = lambda terms: F.array_sort(F.array_intersect(terms, F.col("__words")))
    own = listed(F.filter("own", lambda t: F.length(t) >= 3))
    staff = listed(F.col("staff"))
    others = F.slice(F.array_sort(F.array_except(F.coalesce("__foreign", F.array().cast("array<string>")), F.col("own"))), 1, 5)
    named = lambda label, found: F.when(F.size(found) > 0, F.concat(F.lit(label + ":"), F.array_join(found, ",")))
    single = [
        named("own_name_token", own),
        F.when(F.coalesce(F.regexp_like(F.col("__body"), own_id_pattern(F.col("id_no"), False)), F.lit(False)), "id_no_in_text"),
    ]
    patterns = F.transform(pattern_hits(F.col("__body")), lambda p: F.concat(p, F.lit("_pattern")))
    after = [
        named("metadata_person_token", staff),
        named("possible_name_token", others),
        F.when(F.coalesce(F.element_at("scrub_counts", F.lit("name")), F.lit(0)) > 0, "patient_name_was_in_body_check_scrub"),
    ]
    parse = F.transform(F.filter("warnings", lambda w: w.isin("no_header", "no_impression", "extraction_failed")), lambda w: F.concat(F.lit("parse:"), w))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    last = [F.when(empty("findings") & empty("impression"), "missing_clinical_content"), F.when(F.coalesce("pending", F.lit(False)) & F.lit(block_pending), "linkage_pending_review")]
    arr = lambda cs: F.array_compact(F.array(*cs))
    return df.withColumn("issues", F.concat(arr(single), patterns, arr(after), parse, arr(last))).drop("__body", "__words", "__foreign")


X_FIELDS = ("exam", "clinical_information", "technique", "findings", "impression", "advice")


def status(decision: Column, issues: Column) -> Column:
    """passed_override, failed or passed; null decision as none."""
    d = F.lower(F.trim(F.coalesce(decision, F.lit(""))))
    return F.when(d == "pass", "passed_override").when((d == "fail") | (F.size(issues) > 0), "failed").otherwise("passed")


def sample_size(n: Column, fraction: float = 0.05, minimum: int = 30) -> Column:
    """min(n, max(minimum, n * fraction rounded half to even))."""
    return F.least(n, F.greatest(F.lit(minimum), F.bround(n * F.lit(fraction), 0))).cast("int")


def human_sample(passed: DataFrame, key: str, fraction: float = 0.05, minimum: int = 30, seed: str | None = None) -> DataFrame:
    """Exactly sample_size rows, uniform without replacement: the smallest random numbers, or smallest seeded hashes of ``key``."""
    n = passed.count()
    size = min(n, max(minimum, round(n * fraction)))
    drawn = passed.withColumn("__draw", F.rand().cast("string") if seed is None else F.sha2(F.concat(F.lit(seed), F.col(key)), 256))
    return numbered(drawn, "__at", "__draw", key).where(F.col("__at") < size).drop("__draw", "__at")


def issue_counts(rows: DataFrame) -> DataFrame:
    """(issue, n) by the part before the colon."""
    each = rows.select(F.explode("issues").alias("i"))
    return each.groupBy(F.substring_index("i", ":", 1).alias("issue")).agg(F.count("*").alias("n"))
