"""Where intermediate tables go: the folder that the session names, which driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own in local mode, and an error on a cluster, whose
    machines would each write to their own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _own_folder[0]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
