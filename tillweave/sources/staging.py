"""Staged intermediates: a relation several branches read is written once to shared storage.

A written table survives the loss of executors, cuts the lineage, and lets each reader prune columns and rows, which a
cached or checkpointed row set does not. The folder is an explicit argument or the one the cluster names in
``spark.checkpoint.dir``; without either the relation is persisted, which Spark recomputes where a part of it is lost.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: One folder for everything this process stages, so that it can be removed in one go.
RUN = uuid.uuid4().hex


def shared_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, or None."""
    root = spark.conf.get(_SETTING, None)
    return root.rstrip("/") if root else None


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tillweave-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session, whose tasks all run here, may lack it and gets a temporary
    one; a cluster has to name one."""
    root, master = shared_root(spark), spark.sparkContext.master
    if root is None and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
    return root or _local_root()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path of this run in the shared folder."""
    return staged_path(shared_folder(spark), name)


def staged_path(root: str, name: str) -> str:
    """A new path of this run below a shared folder."""
    return f"{root}/tillweave/{RUN}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *, root: str | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back; persist it where there is no shared folder."""
    root = root or shared_root(df.sparkSession)
    if root is None:
        return df.persist()
    path = staged_path(root, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession, *, root: str | None = None) -> None:
    """Remove all that this process has staged; results that still read it must have been written before."""
    root = root or shared_root(spark)
    if root is None:
        spark.catalog.clearCache()
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/tillweave/{RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
