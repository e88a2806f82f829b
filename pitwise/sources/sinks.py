"""Writes that do not overwrite, repeat or publish by accident."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwise.functions.text import row_digest


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def content_digest(rows: DataFrame) -> str:
    """A digest of the rows in any order: of their number and the sums of the four 64-bit
    parts of the row digests, which are summed where the rows are."""
    d = rows.select(row_digest(*rows.columns).alias("d"))
    sums = [F.sum(F.conv(F.substring("d", at, 16), 16, 10).cast("decimal(38,0)")) for at in (1, 17, 33, 49)]
    return hashlib.sha256(",".join(str(x or 0) for x in d.agg(F.count("*"), *sums).first()).encode()).hexdigest()


def write_with_manifest(rows: DataFrame, path: str) -> dict:
    """Write new Parquet and a manifest beside it: rows, files, and a digest of all row
    digests that is summed where the rows are (any order gives the same)."""
    rows.write.mode("errorifexists").parquet(path)
    spark = rows.sparkSession
    back = spark.read.parquet(path)
    total = F.sum(F.conv(F.substring(row_digest(*back.columns), 1, 12), 16, 10).cast("decimal(38,0)"))
    n, digest = back.agg(F.count("*"), total).first()
    manifest = {"rows": n, "files": len(back.inputFiles()), "digest": str(digest or 0), "columns": ",".join(back.columns)}
    spark.createDataFrame([manifest]).coalesce(1).write.json(path.rstrip("/") + ".manifest")
    return manifest


def write_by_content(rows: DataFrame, folder: str) -> str:
    """Write under a path that names the content; the same content is written once."""
    path = f"{folder.rstrip('/')}/{content_digest(rows)}"
    if not exists(rows.sparkSession, path):
        rows.write.parquet(path)
    return path


def insert_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows whose key is not there yet, one for each key."""
    return new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def merge_evidence(rows: DataFrame, key: str, target: str, season: str, stamp: str, evidence: str) -> DataFrame:
    """One row for each key: the least season, the evidence of the oldest season (the
    newest of those), and whether targets contradict each other, in which case there is
    no target."""
    best = F.min_by(evidence, F.struct(F.col(season), -F.unix_micros(F.col(stamp).cast("timestamp")), evidence))
    one = F.countDistinct(target) <= 1
    return rows.groupBy(key).agg(F.when(one, F.min(target)).alias(target), F.min(season).alias(season), best.alias(evidence), (~one).alias("conflict"))


def ordered_csv(rows: DataFrame, preferred: list[str], path: str) -> None:
    """CSV with the preferred columns first and the others by name."""
    some = [c for c in preferred if c in rows.columns]
    rows.select(*some, *sorted(set(rows.columns) - set(some))).write.option("header", True).csv(path)


def ordinals(rows: DataFrame, batch: int, order: list[Column], within: list[str]) -> DataFrame:
    """Stable ordinals from 0 and the batch that each row is appended in."""
    n = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
    return rows.withColumn("ordinal", n.cast("long")).withColumn("batch", F.floor(F.col("ordinal") / batch))


_POINTER = "CURRENT"


def published(spark: SparkSession, path: str) -> DataFrame:
    """What is published at ``path`` now."""
    fs, pointer = _files(spark, f"{path.rstrip('/')}/{_POINTER}")
    if not fs.exists(pointer):
        raise FileNotFoundError(f"nothing is published at {path}")
    version = spark.read.text(str(pointer.toString())).first()[0]
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def publish(rows: DataFrame, path: str, audit: Callable[[DataFrame], bool]) -> bool:
    """Write a version of its own, audit what was written, and only then point to it. The
    pointer is one small file that is replaced at once, so readers find the old version
    or the new one whatever fails in between; what is there stays if the audit fails."""
    spark, version = rows.sparkSession, f"version-{uuid.uuid4().hex}"
    folder = path.rstrip("/")
    rows.write.parquet(f"{folder}/{version}")
    if not audit(spark.read.parquet(f"{folder}/{version}")):
        return False
    fs, new = _files(spark, f"{folder}/.{version}.pointer")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm, rename = spark._jvm, spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark._sc._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{_POINTER}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, where, overwrite)
    return True
