"""Cutting lineage in iterative operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a folder of the warehouse, which they share as well.
    A session that sets ``spark.cleaner.referenceTracking.cleanCheckpoints``
    has the files of a step removed once nothing refers to it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a step of an iteration in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def python_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread by key over all shuffle partitions, for a Python step on groups.

    Adaptive execution sizes partitions by bytes; a few megabytes that cost
    minutes of Python would end up in one task.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)
