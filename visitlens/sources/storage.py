"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only in one local process, where that is unset, it is a temporary folder; on a
    cluster that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="visitlens-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table and reads it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_changed(spark: SparkSession, folder: str, millis: int) -> None:
    """Sets the time of change of the files in a folder, whichever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(at):
        store.setTimes(status.getPath(), millis, -1)
