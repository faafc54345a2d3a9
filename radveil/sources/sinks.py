"""Sinks: bulk writers by Spark, small reviewer files by the driver."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "\ufeff"


def _text(value) -> str:
    return "" if value is None else str(value)


def write_reviewer_csv(df: DataFrame, path: str | Path, columns: list[str]) -> int:
    """One CSV with BOM and CRLF for people to edit. Rows stream partition by partition; null is empty, booleans True/False."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for row in df.select(*columns).toLocalIterator():
            out.writerow([_text(v) for v in row])
            n += 1
    return n


def _csv_cell(df: DataFrame, name: str) -> Column:
    """A column as a CSV cell: null empty, booleans True/False, quoted where it must be."""
    c = F.col(name)
    kind = dict(df.dtypes)[name]
    text = F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\r\n]'), quoted).otherwise(text), F.lit(""))


def write_csv_parts(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV of any size, written by the executors: the parts joined in order of their names are one file with BOM, header and
    CRLF, and rows in the order of df. Nothing passes the driver."""
    rows = df.select(F.concat_ws(",", *(_csv_cell(df, c) for c in columns)).alias("value"))
    head = df.sparkSession.createDataFrame([(BOM + ",".join(columns),)], "value string").coalesce(1)
    head.unionByName(rows).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_bulk(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Parquet, CSV or JSON lines in parts, by the executors. JSON keeps nulls."""
    base = {"json": {"ignoreNullFields": "false"}, "csv": {"header": "true", "encoding": "UTF-8", "escape": '"'}}.get(fmt, {})
    df.write.mode("overwrite").options(**{**base, **options}).format(fmt).save(path)


def write_json(obj: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(obj, indent=2, ensure_ascii=False), encoding="utf-8")
