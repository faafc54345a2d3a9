"""Scrubbing of identifiers from text fields.

All fields of a record travel as one array, so that each step is one expression and the only step
that needs a callback, the date shift, is one Arrow call.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed as X
from .fields import month_number

_DATE = re.compile(X.DATE_IN_TEXT, re.I)
_FORMS = [re.compile(p) for p in (X.DATE_DAY_MONTH_YEAR, X.DATE_MONTH_DAY_YEAR, X.DATE_ISO, X.DATE_NUMERIC)]
_SLOTS = (("d", "w", "y2"), ("w", "d", "y"), ("y", "m", "d"), ("d", "m", "y2"))
PATTERNS = {"phone": (X.PHONE, False), "email": (X.EMAIL, False), "clinician": (X.CLINICIAN, True), "credential": (X.CREDENTIAL, True), "long_number": (X.LONG_NUMBER, False)}
LABELS = ("clinician", "email", "phone", "id_no", "date", "long_number", "name")


def day_of(text: str) -> date | None:
    """The date a matched piece of text names, as functions.fields.parse_date reads it."""
    for form, slots in zip(_FORMS, _SLOTS):
        if m := form.search(text):
            got = dict(zip(slots, m.groups()))
            year = int(got["y"]) if "y" in got else int(got["y2"]) + 2000 * (int(got["y2"]) < 100)
            month = month_number(got["w"]) if "w" in got else int(got["m"])
            if month:
                try:
                    return date(year, month, int(got["d"]))
                except ValueError:
                    continue
    return None


def shift_dates(text: str, days: int) -> str:
    """Each date in the text as ISO date moved by days, or [DATE] where it is no day of the calendar."""

    def moved(m: re.Match) -> str:
        day = day_of(m[0])
        try:
            return (day + timedelta(days=days)).isoformat() if day else "[DATE]"
        except OverflowError:
            return "[DATE]"

    return _DATE.sub(moved, text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _shift_dates(texts: pd.Series, days: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [x and shift_dates(x, int(n or 0)) for x in t] for t, n in zip(texts, days)])


def escaped(text: Column) -> Column:
    """The text as a literal inside a Java pattern."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s])", r"\\$1")


def own_id_pattern(id_no: Column, ignore_case: bool) -> Column:
    """Pattern of the record's own number; null under three characters."""
    bare = F.trim(id_no)
    return F.when(F.length(bare) >= 3, F.concat(F.lit("(?iuU)" if ignore_case else "(?U)"), F.lit(r"\b"), escaped(bare), F.lit(r"\b")))


def names_pattern(terms: Column) -> Column:
    """Pattern of the name terms of two or more letters, longest first; null if there are none."""
    usable = F.filter(F.array_distinct(terms), lambda t: F.length(t) >= 2)
    by_length = F.transform(F.array_sort(F.transform(usable, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: escaped(s["t"]))
    return F.when(F.size(usable) > 0, F.concat(F.lit(r"(?iuU)\b(?:"), F.array_join(by_length, "|"), F.lit(r")\b")))


def _hits(texts: Column, pattern: Column) -> Column:
    return F.coalesce(F.aggregate(texts, F.lit(0), lambda n, t: n + F.coalesce(F.regexp_count(t, pattern), F.lit(0))), F.lit(0))


def _sub(texts: Column, pattern: Column, by: str) -> Column:
    return F.transform(texts, lambda t: F.coalesce(F.regexp_replace(t, pattern, F.lit(by)), t))


def _total(label: str) -> Column:
    return F.aggregate(F.filter("__n", lambda e: e["l"] == label), F.lit(0), lambda a, e: a + e["n"])


def scrub_fields(df, texts: str, terms: str, id_no: str, shift_days: str):
    """Adds 'scrubbed' (array as ``texts``; null fields become empty) and 'scrub_counts' (map of label to hits).

    Steps in order: clinicians, credentials, e-mails, phones, own number, dates, long numbers, names.
    Null terms, number or shift skip the step (a null shift is 0 days).
    """
    lit = lambda p, i: F.lit(X.java(p, i))
    first = [("clinician", lit(X.CLINICIAN, True), "[CLINICIAN]"), ("clinician", lit(X.CREDENTIAL, True), "[CLINICIAN]"), ("email", lit(X.EMAIL, False), "[EMAIL]"), ("phone", lit(X.PHONE, False), "[PHONE]"), ("id_no", F.col("__id_pattern"), "[ID]")]
    last = [("long_number", lit(X.LONG_NUMBER, False), "[NUMBER]"), ("name", F.col("__name_pattern"), "[NAME]")]
    df = df.withColumns({"__t": F.transform(F.col(texts), lambda t: F.coalesce(t, F.lit(""))), "__id_pattern": own_id_pattern(F.col(id_no), True), "__name_pattern": names_pattern(F.col(terms)), "__n": F.array().cast("array<struct<l:string,n:int>>")})

    def step(df, label, pattern, by):
        # counted only in texts that the replacement has changed
        df = df.withColumn("__u", _sub(F.col("__t"), pattern, by))
        changed = F.zip_with("__t", "__u", lambda t, u: F.when(t != u, F.regexp_count(t, pattern)).otherwise(0))
        found = F.array(F.struct(F.lit(label).alias("l"), F.aggregate(changed, F.lit(0), lambda n, k: n + F.coalesce(k, F.lit(0))).alias("n")))
        return df.withColumn("__n", F.concat("__n", found)).withColumn("__t", F.col("__u")).drop("__u")

    for s in first:
        df = step(df, *s)
    df = df.withColumn("__n", F.concat("__n", F.array(F.struct(F.lit("date").alias("l"), _hits(F.col("__t"), lit(X.DATE_IN_TEXT, True)).alias("n")))))
    df = df.withColumn("__t", _shift_dates(F.col("__t"), F.col(shift_days)))
    for s in last:
        df = step(df, *s)
    sums = [F.struct(F.lit(label).alias("key"), _total(label).alias("value")) for label in LABELS]
    counts = F.map_from_entries(F.filter(F.array(*sums), lambda e: e["value"] > 0))
    return df.withColumns({"scrubbed": F.col("__t"), "scrub_counts": counts}).drop("__t", "__n", "__id_pattern", "__name_pattern")


def pattern_hits(body: Column) -> Column:
    """Labels of the identifier patterns found in the text, in fixed order."""
    return F.array_compact(F.array(*(F.when(body.rlike(X.java(p, i)), F.lit(label)) for label, (p, i) in PATTERNS.items())))
