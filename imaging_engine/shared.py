"""What every operator needs: the tables, the shared folder, blanks."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; a temporary one only where the session has none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="engine-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession, what: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Has the driver drop what no DataFrame refers to any more. Spark removes the shuffle files, broadcasts and checkpoints of such only when
    the driver's JVM collects its garbage, which a driver with memory to spare may put off through a whole job; its heap grows meanwhile."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def strip(c: Column) -> Column:
    """Without the blanks around, of any kind; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
