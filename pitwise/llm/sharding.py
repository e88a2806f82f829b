"""Contiguous shards of nearly equal bytes, from prefix sums over partitions.

The rows are range-partitioned by ``(id, checksum, size)``; each partition's total
comes from one small aggregation, the running sum of those totals gives every
partition its offset, and a window inside the partition gives every row the bytes
before it. Row ``i`` goes to the shard in which its middle byte falls when the
whole byte range is cut at equal targets, so shards are contiguous in id order and
differ from the target by less than one row at either end. Only the partition
totals and one row per shard are ever broadcast.

Defined results: a null text has no bytes and checksum 0; null ids come first;
rows that are equal in id, checksum and size take neighbouring places in either
order; no rows give no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def with_offsets(rows: DataFrame, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """Add, for each ``sums`` entry, the sum of its column over all earlier rows in
    ``order``, its ``total_`` over all rows, and ``idx``, the number of earlier rows. The input's columns must be
    free of the names that start with two underscores."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    table = cut(ranged, name)
    totals = table.groupBy("__part").agg(F.count("*").alias("__idx"), *[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "__part",
        *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in ("idx", *sums)],
        *[F.sum(f"__{k}").over(whole).alias(f"total_{k}") for k in sums],
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = table.select("*", (F.row_number().over(inside) - 1).alias("__row"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__own_{k}") for k, c in sums.items()])
    return own.join(F.broadcast(offsets), "__part").select(
        *rows.columns,
        (F.col("__idx") + F.col("__row")).alias("idx"),
        *[(F.col(f"__{k}") + F.col(f"__own_{k}")).alias(k) for k in sums],
        *[f"total_{k}" for k in sums],
    )


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot``: ``size`` is the UTF-8 bytes plus
    ``overhead``; ``slot`` counts each shard's rows from 0."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = with_offsets(rows, [id_col, "text_crc32", "size"], {"before": F.col("size")}, "sharding")
    placed = placed.withColumn(
        "shard", F.least(F.expr(f"(2 * before + size) * {shards} div (2 * total_before)"), F.lit(shards - 1)).cast("int")
    )
    first = placed.groupBy("shard").agg(F.min("idx").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("idx") - F.col("first")).alias("slot"))
