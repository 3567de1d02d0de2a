"""Cutting lineage through reliable storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder of ``spark.checkpoint.dir``. Where it is unset, a session on one machine (tests) takes a temporary one; on a cluster that is an error, as executors would write to folders of their own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="postloom-checkpoint-")
    context.setCheckpointDir(folder)


def _own_folder(spark: SparkSession) -> str:
    """This application's folder under the checkpoint folder; it is deleted when the driver ends."""
    ensure_checkpoint_dir(spark)
    jsc = spark.sparkContext._jsc
    folder = f"{jsc.sc().getCheckpointDir().get()}/postloom-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once, written to the shared checkpoint folder as a compressed table and read back."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Deletes all tables that ``cut`` has written in this application; frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
