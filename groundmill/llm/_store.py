"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from groundmill.operators.rounds import cut, release, shared_dir  # noqa: F401

#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows, counted exactly and without collecting it."""
    return df.count() <= limit


def cut_clean(df: DataFrame, name: str) -> DataFrame:
    """``cut``, where Spark deletes the shuffle files of the write at its end, not once the driver has collected their handles."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return cut(df, name)
    finally:
        conf.set(CLEANUP, before)
