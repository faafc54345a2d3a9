"""Keyed state carried between runs: ids and date shifts are set once and then kept."""

from __future__ import annotations

import secrets

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Stage


def set_if_absent(state: DataFrame, wanted: DataFrame, key: str, make) -> DataFrame:
    """state plus ``make(rows)`` for the distinct non-null keys of wanted that it lacks. State rows win."""
    new = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(state.select(key), key, "left_anti")
    return state.unionByName(make(new).select(*state.columns))


def random_shifts(reach: int):
    """A maker of shift_days: uniform over -reach..reach without 0, from system entropy, written before use."""

    @F.pandas_udf(T.IntegerType())
    def draw(rows: pd.Series) -> pd.Series:
        got = (secrets.randbelow(2 * reach) - reach for _ in rows)
        return pd.Series([x + (x >= 0) for x in got], dtype="int32")

    def make(new: DataFrame) -> DataFrame:
        return Stage(new.sparkSession, "shifts").write(new.withColumn("shift_days", draw(F.monotonically_increasing_id())))

    return make


def keyed_shifts(reach: int, source: str):
    """The deterministic maker for tests and oracles: the shift depends on the key column only."""

    def make(new: DataFrame) -> DataFrame:
        number = F.conv(F.substring(F.sha2(F.col(source), 256), 1, 8), 16, 10).cast("bigint")
        drawn = (number % (2 * reach)).cast("int") - reach
        return new.withColumn("shift_days", F.when(drawn >= 0, drawn + 1).otherwise(drawn))

    return make


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The merge log with this run's rows; earlier rows stay."""
    return log.unionByName(rows).distinct()
