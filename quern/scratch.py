"""Tables and checkpoints of a session in its shared folder.

The folder is the one that the session names in ``spark.checkpoint.dir``. Where none is
named, a local session (tests) gets one of its own; a cluster session is refused, since
its executors would each write to a disk of their own. Tables are deleted when the
driver's JVM ends, or by ``drop`` once nothing reads them any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster session without ``spark.checkpoint.dir``."""


def ready(spark: SparkSession) -> str:
    """The session's shared folder, set as its checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise NoSharedFolder("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def _on_store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with all below it when the driver ends."""
    found = f"{ready(spark)}/tables/{name}-{uuid.uuid4().hex}"
    store, where = _on_store(spark, found)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return found


def drop(spark: SparkSession, found: str) -> None:
    """Deletes a path that ``path`` gave."""
    store, where = _on_store(spark, found)
    store.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: what comes after starts from there."""
    found = path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(found)
    return df.sparkSession.read.schema(df.schema).parquet(found)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    ready(df.sparkSession)
    return df.checkpoint(eager)
