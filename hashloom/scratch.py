"""Shared working storage for iterative jobs.

Iterative operators cut their lineage by writing a Parquet table into the folder the cluster
names in ``spark.checkpoint.dir`` and reading it back.  Every executor sees that folder, so a
lost executor costs a re-read and never a re-computation of earlier rounds.  Nothing is kept in
an executor's own memory or disk.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only in local mode when it is unset, and removed at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="hashloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_made: list[str] = []  # working tables of this process, in order


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/hashloom/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Whether a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, schema=None) -> tuple[DataFrame, str]:
    """Write ``df`` to shared storage and read it back; returns the new frame and its path.  The shuffle files of the writing go with its end."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema or df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete working tables through Hadoop's file system, whatever store they are in."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """A point in time for ``sweep``."""
    return len(_made)


def sweep(spark: SparkSession, since: int, *keep: str) -> None:
    """Delete the working tables that this process made after ``since``, all but ``keep``; for when results that read them are written."""
    old = [p for p in _made[since:] if p not in keep]
    _made[since:] = [p for p in _made[since:] if p in keep]
    remove(spark, *old)
