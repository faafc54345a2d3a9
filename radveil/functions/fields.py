"""Header field normalisers as native columns: dates, ages, sex, examination class, output ages."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed as X

AGE_NUMBER = r"(\d+(?:\.\d+)?)\s*([A-Za-z]*)"


@lru_cache(maxsize=100_000)
def fuzzy_month(word: str) -> int | None:
    """The month whose name is closest, if close enough."""
    near = difflib.get_close_matches(word.lower(), X.MONTHS, n=1, cutoff=X.MONTH_CUTOFF)
    return X.MONTHS.index(near[0]) + 1 if near else None


def month_number(word: str) -> int | None:
    """1-12 by the first three letters, else by closeness, else None."""
    stem = word.lower()[:3]
    for k, name in enumerate(X.MONTHS, 1):
        if name.startswith(stem):
            return k
    return fuzzy_month(word)


@F.pandas_udf(T.IntegerType())
def _fuzzy_month(words: pd.Series) -> pd.Series:
    return words.map(lambda w: fuzzy_month(w) if w else None).astype("Int32")


def month_column(word: Column) -> Column:
    """month_number as a column; only words without a known stem reach Python."""
    stems = F.create_map(*(x for k, m in enumerate(X.MONTHS, 1) for x in (F.lit(m[:3]), F.lit(k))))
    known = F.element_at(stems, F.substring(F.lower(word), 1, 3))
    return F.coalesce(known, _fuzzy_month(F.when(known.isNull(), F.nullif(word, F.lit("")))))


def ascii_digits(text: Column) -> Column:
    """Bangla digits as 0-9."""
    return F.translate(text, "০১২৩৪৫৬৭৮৯", "0123456789")


def _year(digits: Column) -> Column:
    y = digits.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, X.java(pattern), group), F.lit(""))


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def parse_date(text: Column) -> Column:
    """The first of four date forms that is a day of the calendar; numbers are day before month. Else null."""
    text = ascii_digits(text)
    ints = lambda p, g: _part(text, p, g).try_cast("int")
    a, b, c, d = X.DATE_DAY_MONTH_YEAR, X.DATE_MONTH_DAY_YEAR, X.DATE_ISO, X.DATE_NUMERIC
    return F.coalesce(
        _safe(_year(_part(text, a, 3)), month_column(_part(text, a, 2)), ints(a, 1)),
        _safe(ints(b, 3), month_column(_part(text, b, 1)), ints(b, 2)),
        _safe(ints(c, 1), ints(c, 2), ints(c, 3)),
        _safe(_year(_part(text, d, 3)), ints(d, 2), ints(d, 1)),
    )


def _safe(y: Column, m: Column, d: Column) -> Column:
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull() & (y >= 1), _day(y, m, d))


def parse_age_years(text: Column) -> Column:
    """First number with its unit in years, 0 to 120; else null."""
    text = ascii_digits(text)
    number = F.regexp_extract(text, X.java(AGE_NUMBER), 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, X.java(AGE_NUMBER), 2))
    years = (
        F.when(unit.startswith("m") & ~unit.startswith("mi"), number / 12)
        .when(unit.startswith("d"), number / F.lit(365.25))
        .when(unit.startswith("w"), number / F.lit(52.18))
        .otherwise(number)
    )
    return F.when(years.between(0, 120), years)


def parse_sex(text: Column) -> Column:
    """M or F by the first letter, else U."""
    first = F.substring(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+", "")), 1, 1)
    return F.when(first == "m", "M").when(first == "f", "F").otherwise("U")


def exam_class(examined: Column, technique: Column, title: Column) -> Column:
    """Struct modality, contrast, body_region; nulls count as empty."""
    empty = F.lit("")
    exam, tech, head = (F.lower(F.coalesce(c, empty)) for c in (examined, technique, title))
    both = F.concat(exam, F.lit(" "), tech)
    hit = lambda text, p: text.rlike(X.java(p))
    modality = (
        F.when(exam.contains("hrct"), "HRCT")
        .when(hit(exam, X.MODALITY_CTA), "CT angiography")
        .when(hit(exam, X.MODALITY_MRI), "MRI")
        .when(hit(exam, X.MODALITY_CT), "CT")
        .when(hit(F.concat(exam, F.lit(" "), head), X.MODALITY_XRAY), "X-ray")
        .when(hit(head, r"\bct\b"), "CT")
        .otherwise("other")
    )
    contrast = F.when(hit(both, X.CONTRAST_WITH), "with contrast").when(hit(both, X.CONTRAST_WITHOUT), "without contrast").otherwise("unspecified")
    found = F.array_compact(F.array(*(F.when(hit(exam, p), F.lit(name)) for name, p in X.REGIONS.items())))
    region = F.coalesce(F.nullif(F.array_join(found, ";"), empty), F.lit("unspecified"))
    return F.struct(modality.alias("modality"), contrast.alias("contrast"), region.alias("body_region"))


def birth_year(report_date: Column, age: Column) -> Column:
    """Mid-year estimate, cut toward zero; null if either is null."""
    return (F.year(report_date) + F.dayofyear(report_date) / F.lit(365.25) - age - F.lit(0.5)).cast("int")


def age_text(age: Column) -> Column:
    """Whole years, '90+' from 90, '' for null."""
    return F.when(age.isNull(), "").when(F.floor(age) >= 90, "90+").otherwise(F.floor(age).cast("string"))


def age_band(age: Column) -> Column:
    """Five-year band, '90+' from 90, '' for null."""
    low = F.floor(age) - F.floor(age) % 5
    return F.when(age.isNull(), "").when(F.floor(age) >= 90, "90+").otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string")))


def shifted(date: Column, days: Column) -> Column:
    """ISO text of the date moved by days; null for a null date."""
    return F.date_format(F.date_add(date, days), "yyyy-MM-dd")


def folder_date(folder: Column) -> Column:
    """Date of a folder named d-m-yyyy; null for other names and impossible days."""
    p = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    return _safe(_part(folder, p, 3).cast("int"), _part(folder, p, 2).cast("int"), _part(folder, p, 1).cast("int"))


def file_stem(path: Column) -> Column:
    """Last path component without its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def filename_tokens(path: Column) -> Column:
    """Lower-case runs of two or more letters of the stem; empty array for null."""
    runs = F.regexp_extract_all(F.coalesce(file_stem(path), F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0))
    return F.transform(runs, F.lower)
