"""Spark session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

WORK_DIR_SETTING = "spark.checkpoint.dir"
_local_work_dir: str | None = None
_runs: list[str] = []


def session(app: str = "promptroute", **conf: object) -> SparkSession:
    """A session with the settings the engine is tuned for.

    Only settings that hold on any cluster are set here; the master, memory and
    ``spark.checkpoint.dir`` come from spark-submit or from ``conf``.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{k: str(v) for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is used only where that setting is missing and the session
    is local, since all executors must be able to read the folder.
    """
    global _local_work_dir
    configured = spark.conf.get(WORK_DIR_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {WORK_DIR_SETTING} to a folder all executors share")
    if _local_work_dir is None:
        _local_work_dir = tempfile.mkdtemp(prefix="promptroute-")
    return _local_work_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_runs[-1] if _runs else work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """Within it intermediate tables go to a folder of their own, which is deleted when the block ends well.

    Results have to be written inside, since they read those tables.  After a failure the folder stays, to be looked at.
    """
    path = new_path(spark, name)
    _runs.append(path)
    try:
        yield path
    finally:
        _runs.pop()
    delete(spark, path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in the folder ``path``; none if there is no such folder."""
    system, place = file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete the folder ``path`` with all it holds, if it is there."""
    system, place = file_system(spark, path)
    system.delete(place, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    Cuts the lineage with a table that outlives executors, and gives the
    optimizer the true size of ``df``, so that a later join broadcasts it only
    if it is small.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
