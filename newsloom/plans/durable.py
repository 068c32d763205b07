"""Cutting a lineage through the shared folder that the cluster names.

``localCheckpoint`` keeps one copy on one executor; losing that executor fails
the job. Everything here goes through ``spark.checkpoint.dir`` instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, local mode gets a folder of its own; a cluster is told to set it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint; its lineage ends there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, into: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder (or to a folder in it) and read back; column statistics come with it."""
    path = f"{into or shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A folder in the shared one for what an operator writes on its way; it goes at the end, so nothing returned may read it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
