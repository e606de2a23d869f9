"""The shared folder of the cluster: checkpoints, and tables that several jobs read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset a temporary folder takes its
    place, but only if everything runs in one machine (local master, as in tests)."""
    sc = spark.sparkContext
    set_here = sc._jsc.sc().getCheckpointDir()
    if set_here.isDefined():
        return set_here.get()
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small or middling table with checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder as Parquet and reads it again: columns are pruned and its size is known."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
