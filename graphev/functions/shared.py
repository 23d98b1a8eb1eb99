"""What the driver and all executors share: a folder, and this package's code."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local temporary folder where that is unset (local runs)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a result that is stored here leaves the executors' disks with the job's end, as
    only the stored rows are read again. Else it stays until the driver's memory happens to be cleared."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    with clearing(df.sparkSession):
        return df.select("*").checkpoint()  # a DataFrame clears as was set when it was made


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df, written once to the shared folder as Parquet and read from there, so that its size is known."""
    folder = folder or new_dir(df.sparkSession, name)
    with clearing(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Takes a folder of new_dir() away that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for an application, so that their functions
    find it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(tempfile.mkdtemp(prefix="spark-") + "/graphev", "zip", root, "graphev")
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
