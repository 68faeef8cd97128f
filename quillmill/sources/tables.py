"""Intermediate tables: Parquet in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Unset, a run on one machine gets a temporary folder; on
    a cluster that would lose data, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        if option.isDefined():
            return option.get()
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.gettempdir()}/quillmill-checkpoint")
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession, name: str = "quillmill") -> str:
    """A new path under the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at, files = hadoop_path(spark, path)
    files.deleteOnExit(at)
    return path


#: Rows handed to Python at once; texts are long, and Spark's default of 10000 holds too many.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bound what a Python worker holds, however many rows a partition has."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: Rows of a written table that are sent whole to every task.
SENT = 100_000


def sized(df: DataFrame, most: int = SENT) -> DataFrame:
    """df with the way in which it is joined: sent to every task if it has at most `most` rows,
    else by a merge. df is counted, so it should be a written table. Spark judges by the bytes
    of files, and rows that compress well or are exploded look smaller there than they are."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Write df and read it back: what follows starts from files that outlive any executor, and
    what was computed is computed once."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
