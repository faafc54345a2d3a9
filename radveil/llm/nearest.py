"""Nearest records in time by disjoint intervals.

The right side becomes intervals of days, one per key and day: from the midpoint to the day before up to
the midpoint to the next, cut at the tolerance; a day at equal distance goes to the smaller id. Intervals of
one key don't overlap, so each left row meets at most one. They are indexed by blocks of days, and the
join is on key and block: a key with any share of the rows is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_DAYS = 8


def intervals(right: DataFrame, key: str, day: str, ident: str, tolerance: int) -> DataFrame:
    """(key, ident, lo, hi) in days since 1970: the days for which the row is the nearest within tolerance.

    Null keys and days give nothing. Rows of one key and day are reduced to the smallest ident before the window, so a window
    holds no more rows than the calendar has days.
    """
    per_day = right.where(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(key).alias("key"), F.unix_date(day).alias("d")).agg(F.min(ident).alias("id"))
    w = W.partitionBy("key").orderBy("d")
    near = per_day.withColumns({"d0": F.lag("d").over(w), "id0": F.lag("id").over(w), "d1": F.lead("d").over(w), "id1": F.lead("id").over(w)})

    def last_of(d: str, i: str, e: str, j: str) -> Column:
        """The last day nearer to (d, i) than to the later (e, j)."""
        half = F.floor((F.col(d) + F.col(e)) / 2).cast("int")
        tie = ((F.col(d) + F.col(e)) % 2 == 0) & (F.col(j) < F.col(i))
        return half - F.when(tie, 1).otherwise(0)

    lo = F.greatest(F.col("d") - tolerance, F.coalesce(last_of("d0", "id0", "d", "id") + 1, F.col("d") - tolerance))
    hi = F.least(F.col("d") + tolerance, F.coalesce(last_of("d", "id", "d1", "id1"), F.col("d") + tolerance))
    return near.select("key", F.col("id").alias("ident"), F.col("d").alias("day"), lo.alias("lo"), hi.alias("hi"))


def nearest(left: DataFrame, right: DataFrame, key: str, day: str, ident: str, tolerance: int) -> DataFrame:
    """left's rows with right's nearest ``ident`` of the same key and its distance in days; rows without one are left out.

    ``key`` and ``day`` (a date) are columns of both. Null keys and days match nothing.
    """
    spans = intervals(right, key, day, ident, tolerance).where("lo <= hi")
    block = lambda c: F.floor(c / BLOCK_DAYS)
    index = spans.withColumn("block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))))
    l = left.where(F.col(key).isNotNull() & F.col(day).isNotNull()).withColumn("__d", F.unix_date(day)).withColumn("block", block(F.col("__d")))
    met = l.join(index.withColumnRenamed("key", "__key").withColumnRenamed("day", "__day").withColumnRenamed("ident", "__ident"), (l[key] == F.col("__key")) & (l["block"] == index["block"]) & F.col("__d").between(F.col("lo"), F.col("hi")))
    return met.select(*(l[c] for c in left.columns), F.col("__ident").alias("ident"), F.abs(F.col("__d") - F.col("__day")).alias("distance"))


def bare(c: Column) -> Column:
    """Without any white space, letter case ignored; null if nothing is left."""
    return F.nullif(F.lower(F.upper(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", ""))), F.lit(""))


def study_day(c: Column) -> Column:
    """The day of exactly eight digits that form a date, else null."""
    ok = c.rlike(r"^[0-9]{8}\z") & (F.substring(c, 1, 4) != "0000")
    return F.when(ok, F.try_to_date(F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)), "yyyy-MM-dd"))


def found(headers: DataFrame, identity: DataFrame, tolerance: int = 3) -> DataFrame:
    """(file, uid): each DICOM file with its nearest report. Repeated rows count once; a file that stands in several rows
    with different numbers or dates gets the nearest report of all, at equal distance the smaller uid."""
    studies = headers.select("file", bare(F.col("patient_id")).alias("no"), study_day(F.col("study_date")).alias("at")).where("file is not null and no is not null and at is not null").distinct()
    reports = identity.select("uid", bare(F.col("id_no")).alias("no"), F.col("report_date").try_cast("date").alias("at")).where("uid is not null")
    got = nearest(studies, reports, "no", "at", "uid", tolerance)
    best = got.groupBy("file").agg(F.min(F.struct("distance", "ident")).alias("b"))
    return best.select("file", F.col("b.ident").alias("uid"))
