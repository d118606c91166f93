"""A session with the settings that published results depend on."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import SparkSession

#: Removes what a query has exchanged from the executors' disks once it ends; else that lies there until the driver's collector comes by.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Record hashes contain timestamps as text, so the zone is pinned; dates are overwritten partition by partition.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    DROP_SHUFFLES: "true",
}


def session(app_name: str = "kelpline", warehouse: str | None = None, master: str | None = None, **settings: str) -> SparkSession:
    """A session on the given master, else on the one that spark-submit names, else on this machine."""
    builder = SparkSession.builder.appName(app_name).config(map=SETTINGS | settings)
    if master or not SparkConf().contains("spark.master"):
        builder = builder.master(master or "local[*]")
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    return builder.getOrCreate()


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Each query's exchanged rows go when it ends, in a session that isn't ours as in one of ``session``."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine, where it may be unset, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/kelpline-scratch"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base


def delete_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Remove a folder when the driver's file systems close, which is after all that may still read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
