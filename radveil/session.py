"""Session defaults and lineage cutting through the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REDACTION = r"(?i)secret|password|[0-9a-f]{64}"


def build_session(app: str = "radveil", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and redaction of key-like strings in plans."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.redaction.string.regex": REDACTION,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=base | conf).getOrCreate()
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one if all runs in this process (local mode);
    on a cluster an error, for there each executor would write its parts to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="radveil-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Stage:
    """Tables written to the shared folder: lineage ends there, sizes are known, executors may be lost.

    ``keep`` tables live until the session ends (a returned DataFrame may still read them);
    others go with ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone already
            if path.startswith("file://"):
                import shutil

                shutil.rmtree(path[7:], ignore_errors=True)

    def write(self, df: DataFrame) -> DataFrame:
        """Write df and return it as read back."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._radveil_path = path
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        """Delete tables of this stage that nothing will read again."""
        for df in dfs:
            path = getattr(df, "_radveil_path", None)
            if path:
                self._remove(path)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session; they need no path of the driver's."""
    sc = spark.sparkContext
    if not getattr(sc, "_radveil_shipped", False):
        home = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="radveil-py-")) / "radveil.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(str(target))
        sc._radveil_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    ship(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
