"""Session helpers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the context was given.

    Only a ``local`` session, where driver and executors are one process, may fall back to a temporary folder.
    Anywhere else a machine-local folder would lose its files with the machine, so its absence is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pagetone-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def unguessed(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by shuffle, however small Spark takes it to be.

    Spark guesses a side that is built from a table by the size of the table's files and the number of columns: few columns
    of many rows, packed or exploded, pass for a small table, and their broadcast fills the driver.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and keeps iterative plans short.

    Its files go when the session is started with ``spark.cleaner.referenceTracking.cleanCheckpoints`` and
    the result is no longer referenced.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
