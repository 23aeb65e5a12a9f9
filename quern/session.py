"""Sessions, shipping of the package to workers, and reading of the standard tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Bytes of an Arrow batch on its way to a Python worker; Spark's own default is 64 MB, for each of a task's workers.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests and benches; on a cluster the session comes from outside."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make ``quern`` importable in Python workers when the path does not already provide it, and keep their batches small.

    With --py-files, PYTHONPATH or the repository as working directory nothing is sent. The bytes of a batch are left alone
    where the session's configuration names them.
    """
    sc = spark.sparkContext
    if sc.getConf().get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    reachable = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    if os.path.realpath(ROOT) in reachable or (os.path.exists("quern") and os.path.realpath("quern") == str(ROOT / "quern")):
        return
    if sc.applicationId in _shipped:
        return
    bundle = os.path.join(tempfile.mkdtemp(), "quern.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for p in (ROOT / "quern").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(bundle)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables; the path may be any that Spark's readers know."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; a table of one file and row group makes one task otherwise.
    Only tables of few partitions are dealt out, so a large one is read where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
