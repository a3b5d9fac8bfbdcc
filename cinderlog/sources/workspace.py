"""Folders every executor can reach, for tables a job writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


@cache
def _own_folder() -> str:
    """A folder of this process, for sessions whose only machine is the driver's; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="cinderlog-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a session on one machine gets a folder of the process. A cluster is refused: what
    executors write to folders of their own machine cannot be read back.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not _one_machine(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result and read it back.

    This cuts the lineage, survives lost executors, and gives Spark the true size: the planner
    broadcasts it below spark.sql.autoBroadcastJoinThreshold and shuffles it above.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the folders this process has made; call it when no DataFrame that reads them is needed any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(path.getFileSystem(hadoop).delete(path, True))
    return gone
