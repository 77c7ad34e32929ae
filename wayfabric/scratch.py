"""Shared scratch storage: written tables that cut lineage and survive lost executors.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting
is absent and the master is local (tests, a laptop) is a temporary folder made and used.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; unset, a temporary one on a local master, else RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="wayfabric-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it."""
    return spark_read(df.sparkSession, write_scratch(df, name))


def write_scratch(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet under a fresh path of the shared folder and return the path."""
    path = f"{_home(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return path


def _home(spark: SparkSession) -> str:
    """This application's part of the scratch folder; deleted when the driver's interpreter ends."""
    app = spark.sparkContext.applicationId
    home = f"{scratch_dir(spark)}/wayfabric/{app}"
    if f"home-{app}" not in _LOCAL:
        _LOCAL[f"home-{app}"] = home
        atexit.register(_leave, spark, home)
    return home


def _leave(spark: SparkSession, home: str) -> None:
    if home.startswith("file:"):
        shutil.rmtree(home.removeprefix("file://"), ignore_errors=True)
    elif spark.sparkContext._jsc is not None:  # the application still runs
        discard(spark, home)


def spark_read(spark: SparkSession, path: str) -> DataFrame:
    """Scan a scratch table."""
    return spark.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have ended, by collecting the driver's garbage.

    Between the steps of a long operator, so that the disk holds the largest step, not their sum.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of ``rows``, unless the session already asks for fewer.

    The default of 10,000 whole documents would hold tens of megabytes on both sides of each task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


@contextmanager
def batches(spark: SparkSession, rows: int = 10_000) -> Iterator[None]:
    """Inside, tables of a few numbers a row are handed to Python in batches of ``rows``, whatever the session asks for texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def join_filters(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark may filter the large side of a shuffled join by a Bloom filter of the small side's keys.

    Spark builds the filter itself, at a fixed largest size, where the small side has a selective predicate;
    by default it does so for scans over 10 GB only.
    """
    wanted = {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it."""
    app = f"ship-{spark.sparkContext.applicationId}"
    if app not in _LOCAL:
        package = Path(__file__).resolve().parent
        if package.is_dir():
            stem = Path(tempfile.mkdtemp(prefix="wayfabric-ship-")) / "wayfabric_package"
            made = shutil.make_archive(str(stem), "zip", root_dir=package.parent, base_dir=package.name)
            spark.sparkContext.addPyFile(made)
        _LOCAL[app] = "sent"
