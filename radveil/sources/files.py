"""Sources: folders of Word reports, reviewer files, staged JSON lines."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import OLE_FIELDS, OLE_MAGIC
from ..operators.ranking import numbered

CONVERTER_TIMEOUT = 120  # Fixed value: seconds per attempt


def find_converter(explicit: str | None = None) -> str:
    """Path of the text converter: the given one, else the one on PATH."""
    for candidate in (explicit, shutil.which("antiword")):
        if candidate and Path(candidate).exists():
            return str(candidate)
    raise FileNotFoundError("no converter found; give its path")


def is_lock(path: str) -> Column:
    return F.coalesce(F.element_at(F.split(path, "/"), -1).startswith("~$"), F.lit(False))


def listed(paths: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, file_index) of the Word files among distinct paths, lock files left out. Order is by path components; ``limit`` cuts it."""
    words = paths.select("path").where(F.col("path").rlike(r"(?i)[^/]\.doc$") & ~is_lock("path")).distinct()
    order = numbered(words, "file_index", F.split("path", "/")).withColumn("file_index", F.col("file_index").cast("int"))
    return order if limit is None else order.where(F.col("file_index") < limit)


def list_source_files(spark: SparkSession, folder: str, limit: int | None = None) -> tuple[DataFrame, int]:
    """(files with file_index, number of lock files)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][oO][cC]").load(folder)
    locks = raw.select("path").where(is_lock("path")).count()
    # numbered over paths only; the content doesn't travel through the sort
    return raw.join(listed(raw, limit), "path").drop("modificationTime"), locks


def _convert(converter: str, content: bytes) -> tuple[str, str | None]:
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:
        f.write(content)
        f.flush()
        for options in (["-m", "UTF-8.txt", "-w", "0"], ["-w", "0"]):
            try:
                done = subprocess.run([converter, *options, f.name], capture_output=True, timeout=CONVERTER_TIMEOUT)
            except subprocess.TimeoutExpired:
                return "", "converter timeout"
            if done.returncode == 0:
                return done.stdout.decode("utf-8", errors="replace"), None
        return "", f"converter exit code {done.returncode}"


def _ole_meta(content: bytes) -> dict[str, str]:
    """Summary fields of a Word file; {} where they can't be read or the reader isn't installed."""
    try:
        import io

        import olefile

        with olefile.OleFileIO(io.BytesIO(content)) as ole:
            found = ole.get_metadata()
        values = {f: getattr(found, f, None) for f in OLE_FIELDS}
        text = {f: v.decode("cp1252", errors="replace") if isinstance(v, bytes) else str(v) for f, v in values.items() if v}
        return {f: v.strip("\0 ").strip() for f, v in text.items()}
    except Exception:
        return {}


def extract(files: DataFrame, folder: str, converter: str) -> DataFrame:
    """SOURCE_FILES rows. Hash, size and the Word check are native; text and metadata come from a Python step per batch.
    A failed conversion is a row with an error, never an exception."""
    root = folder.rstrip("/")

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())]))
    def read(contents: pd.Series) -> pd.DataFrame:
        rows = [(*_convert(converter, bytes(c)), _ole_meta(bytes(c))) for c in contents]
        return pd.DataFrame({"text": [r[0] for r in rows], "meta": [r[2] for r in rows], "error": [r[1] for r in rows]})

    bare = F.regexp_replace("path", "^file:/*", "/")
    got = files.withColumns({"__read": read("content"), "path": bare})
    return got.select(
        "file_index", "path", F.substr(F.col("path"), F.lit(len(root) + 2)).alias("rel"), F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.sha2("content", 256).alias("sha256"), F.col("length").cast("bigint").alias("size"),
        (F.substring("content", 1, 8) == F.unhex(F.lit(OLE_MAGIC))).alias("is_ole"), "__read.text", "__read.meta", "__read.error",
    )


def read_reviewer_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A reviewer's CSV by name of column, UTF-8 with or without BOM; a missing file gives no rows."""
    if not Path(path.removeprefix("file://")).exists():
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)
