"""Cutting lineage in the folder that all executors share: checkpoints and written tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of our own; on a cluster, whose executors
    would not see each other's files in one, that is an error."""
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint: computed once, kept in shared storage, so it outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` deletes with the tables."""
    path = f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back, so later plans see their true size."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that ``written`` made in this application and that are still there, oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables that ``written`` made in this application, all if no paths are given; call it when results that read
    them are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    known = _written.get(spark.sparkContext.applicationId, [])
    for path in [x for x in known if paths is None or x in paths]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        known.remove(path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):
        if (spark := SparkSession.getActiveSession()) is not None:
            release(spark)
