"""Tables on the storage that all executors share.

``cut`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it
back: the lineage ends there, so a lost executor costs no recomputation of what
came before, and a value such as a partition number is fixed once for all
readers. The shuffle files of the written plan are removed as soon as the table
stands (Spark's own clean-up at the end of an execution), so a long job holds those
of one step at a time on its disks. The folder is read from the session; where it is
unset a local master gets a temporary folder, as in tests, and any other an error,
as executors would each write to their own disks. Tables lie in a folder named
after the application, which is removed as the driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{_DIR} must name a folder that all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="pitwise-")
        spark.conf.set(_DIR, where)
    own = f"{where.rstrip('/')}/pitwise-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_drop, spark._jvm.org.apache.hadoop.fs.Path(own), spark._jsc.hadoopConfiguration())
    return own


_folders: set[str] = set()


def _drop(folder, conf) -> None:
    """At the end of the driver's Python the application's folder goes; if the JVM went first it stays."""
    with suppress(Exception):
        folder.getFileSystem(conf).delete(folder, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Executions inside remove their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    for each in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(each)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Remove tables made by ``cut`` on which nothing depends any more."""
    for table in tables:
        remove(table.sparkSession, *{f.rsplit("/", 1)[0] for f in table.inputFiles()})
