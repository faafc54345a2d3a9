"""Positions in a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Stage


def numbered(rows: DataFrame, column: str, *order: Column | str) -> DataFrame:
    """rows with their 0-based position by ``order`` (bigint): rows are cut into ranges, each is numbered by itself, and
    the sizes of the ranges before it are added. One count per range reaches the driver. Rows of equal order keep any order."""
    stage = Stage(rows.sparkSession, "numbered")
    cut = stage.write(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before, starts = 0, []
    for r in sorted(cut.groupBy("__range").count().collect()):
        starts.append((r["__range"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "__range int, __start long")
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return cut.withColumn("__at", inside).join(F.broadcast(starts), "__range").withColumn(column, F.col("__start") + F.col("__at") - 1).drop("__range", "__at", "__start")
