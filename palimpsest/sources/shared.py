"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


class _Made(threading.local):
    """The paths that a thread has made and not removed, oldest first: threads do not remove each other's."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none: a temporary one, and only if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest_shared_")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, among those of the application."""
    path = f"{shared_folder(spark)}/{kind}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _made.paths.append(path)
    return path


def materialized(df: DataFrame, kind: str = "tables", block: int = 128 << 20) -> DataFrame:
    """df written to the shared folder and read back: computed once, and a lost executor costs a reread only.

    block: bytes of a row group. One task reads a whole one, so small ones deal costly rows more evenly.
    """
    path = shared_path(df.sparkSession, kind)
    df.write.option("parquet.block.size", block).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The paths that this thread has made so far; what it makes later may be given to `removed` once it is not read any more."""
    return list(_made.paths)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes paths of the shared folder. Frames that still read them fail, so only whoever has used up such frames may call this."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made.paths:
            _made.paths.remove(path)
