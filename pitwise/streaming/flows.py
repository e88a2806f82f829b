"""Incremental ingestion and windows over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pitwise.operators.temporal import first_by
from pitwise.sources.sinks import exists, insert_absent, publish, remove


def land(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str], gate: Callable[[DataFrame], bool] | None = None) -> StreamingQuery:
    """Take what is new in a folder of Parquet files, once, into an append-only table.
    Keys that the table has are dropped, so a replay lands nothing twice. A batch that
    fails the gate is parked whole beside the table (``target.parked``), from where
    ``reclaim`` takes it. The checkpoint names the run: Spark lets one query at a time
    use it."""

    def batch(rows: DataFrame, number: int) -> None:
        if gate is not None and not gate(rows):
            rows.write.mode("overwrite").parquet(f"{parked(target)}/batch={number}")
        else:
            append_absent(spark, rows, target, key)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parked(target: str) -> str:
    return target.rstrip("/") + ".parked"


def append_absent(spark: SparkSession, rows: DataFrame, target: str, key: list[str]) -> None:
    there = spark.read.schema(rows.schema).parquet(target) if exists(spark, target) else rows.limit(0)
    insert_absent(there, rows, key).write.mode("append").parquet(target)


def reclaim(spark: SparkSession, schema: str, target: str, key: list[str], gate: Callable[[DataFrame], bool]) -> bool:
    """Land the parked batches, if together they pass the gate, and clear them."""
    if not exists(spark, parked(target)):
        return False
    rows = spark.read.schema(schema).parquet(f"{parked(target)}/batch=*")
    if not gate(rows):
        return False
    append_absent(spark, rows, target, key)
    remove(spark, parked(target))
    return True


def claimable_runs(runs: DataFrame, key: str, status: str, started: str, now: Column, stale: str = "1 hour") -> DataFrame:
    """Of each key's latest run, whether a new one may claim it: a failed run, or one that
    has been running for longer than ``stale``; finished and live ones may not."""
    last = first_by(runs, [key], [F.col(started).desc_nulls_last(), F.col(status)])
    late = (F.col(status) == "running") & (F.col(started) < now - F.expr(f"interval {stale}"))
    return last.withColumn("claimable", F.coalesce((F.col(status) == "failed") | late, F.lit(False)))


class _Reclaim(StatefulProcessor):
    """One live run for each key; a run that says nothing for the time given is given up:
    when another reports for the key, or, with timers, when that time has passed."""

    def __init__(self, stale_ms: int, timers: bool):
        self.stale_ms, self.timers = stale_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "run string, at long")

    def _wait(self, timers, live: bool) -> None:
        """From now on one timer, if a run is live, else none."""
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if live:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.stale_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.run.get() if self.run.exists() else None
        self.run.clear()
        yield pd.DataFrame([] if held is None else [(key[0], held[0], "expired")], columns=["key", "run", "state"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for run, status, at in zip(pdf["run"], pdf["status"], pdf["at"]):
                ms = int(pd.Timestamp(at).value // 1_000_000)
                held = self.run.get() if self.run.exists() else None
                if status in ("succeeded", "failed"):
                    if held is not None and held[0] == run:
                        self.run.clear()
                    out.append((key[0], run, status))
                elif held is None or held[0] == run or ms - held[1] > self.stale_ms:
                    if held is not None and held[0] != run:
                        out.append((key[0], held[0], "reclaimed"))
                    self.run.update((run, ms))
                    out.append((key[0], run, "running"))
                else:
                    out.append((key[0], run, "refused"))
        if any(state != "refused" for *_, state in out):
            self._wait(timerValues, self.run.exists())
        yield pd.DataFrame(out, columns=["key", "run", "state"])

    def close(self) -> None:
        pass


def run_states(reports: DataFrame, stale_ms: int = 3_600_000, timers: bool = False) -> DataFrame:
    """``key, run, state`` of a stream of ``key, run, status, at`` reports: a second run of
    a key is refused while one is live, and takes over when that is stale. With ``timers`` a
    run that has not reported for ``stale_ms`` of processing time is ``expired`` without any
    further report, and its state goes; else state ends only as its key reports."""
    schema = "key string, run string, state string"
    return reports.groupBy("key").transformWithStateInPandas(_Reclaim(stale_ms, timers), schema, "Append", "ProcessingTime" if timers else "None")


def freshness(events: DataFrame, keys: list[str], time: str, now: Column, stale: str = "26 hours") -> DataFrame:
    """``last_seen``, hours since then, and whether that is longer than ``stale``."""
    last = events.groupBy(*keys).agg(F.max(time).alias("last_seen"))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 3.6e9
    return last.withColumn("stale_hours", F.round(hours, 2)).withColumn("alarm", F.col("last_seen") < now - F.expr(f"interval {stale}"))


def publish_each(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], audit: Callable[[DataFrame], bool]) -> StreamingQuery:
    """Rebuild and publish a table at each batch, if its audit passes."""
    return stream.writeStream.foreachBatch(lambda rows, number: publish(make(rows), path, audit)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, width: str, slide: str | None, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; the same for batch and stream."""
    rows = events.withWatermark(time, late) if late else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
