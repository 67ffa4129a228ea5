"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset: on one machine (``local``) a temporary folder; on a cluster an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lexmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


#: Paths given out by this process, by application.
_given: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. What is written there stays until ``clear``, or until the folder is cleared."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes all that was written under paths of ``shared_path`` in this session, and says how many there were.

    Results are read from these tables when they are used, so all must be saved or collected before.
    """
    gone = 0
    for path in _given.pop(spark.sparkContext.applicationId, []):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written in the shared folder: what several parts of a plan need is worked out once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
