"""Streams: versions that an audit keeps back, repeats and late rows, and runs that fall silent; readers and notes."""

from __future__ import annotations

import time
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.functions import numbers, roster
from pitwise.operators import audits, careers, panel
from pitwise.plans import models
from pitwise.sources import readers, sinks
from pitwise.streaming import flows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def test_a_failed_audit_leaves_the_last_good_version(spark, tmp_path):
    src, out, schema = f"{tmp_path}/in", f"{tmp_path}/view", "k long, v double"
    run = lambda: flows.publish_each(
        spark.readStream.schema(schema).parquet(src), out, f"{tmp_path}/cp", lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v")), lambda made: made.filter("v < 0").isEmpty() and not made.isEmpty()
    ).awaitTermination()
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    seen = lambda: sorted(tuple(r) for r in sinks.published(spark, out).collect())
    put([(1, 2.0), (1, 3.0), (2, 1.0)])
    run()
    assert seen() == [(1, 5.0), (2, 1.0)]
    put([(1, -9.0)])
    run()
    assert seen() == [(1, 5.0), (2, 1.0)]  # the batch that fails is not published
    put([(3, 4.0)])
    run()
    assert seen() == [(3, 4.0)]


def _stream(spark, path, rows, schema, make, name, tmp_path):
    """Each list of rows is a batch of its own; what the stream gives in append mode."""
    stream = None
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        kind = spark.read.parquet(path).schema
        stream = make(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start(f"{tmp_path}/{name}")
        stream.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/{name}").collect()


def test_repeats_within_the_watermark_count_once(spark, tmp_path):
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    batches = [[("a", at(1), 1), ("a", at(1, 5), 2), ("b", at(1), 3)], [("a", at(1, 20), 4), ("c", at(2), 5)], [("b", at(2, 10), 6)]]
    got = _stream(spark, f"{tmp_path}/in", batches, "k string, at string, n int", lambda s: flows.deduplicated(s, ["k"], "at", "2 hours"), "once", tmp_path)
    assert sorted(r.k for r in got) == ["a", "b", "c"]


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02d}:10:00"
    batches = [[("a", at(1), 1.0), ("a", at(2), 2.0)], [("a", at(9), 4.0)], [("a", at(1), 100.0), ("a", at(9), 8.0)], [("a", at(20), 1.0)], [("a", at(21), 1.0)]]
    got = _stream(spark, f"{tmp_path}/in", batches, "k string, at string, v double", lambda s: flows.windowed(s, "at", "1 hour", None, ["k"], "v", "1 hour"), "hours", tmp_path)
    assert sorted((r.start.hour, r.n, r.total) for r in got) == [(1, 1, 1.0), (2, 1, 2.0), (9, 2, 12.0)]  # 100 came when its hour was closed


def test_a_silent_run_expires_without_a_further_report(spark, tmp_path):
    schema = "key string, run string, status string, at string"
    made = spark.createDataFrame([("a", "1", "running", "2024-01-01 01:00:00"), ("b", "2", "running", "2024-01-01 01:00:00"), ("b", "2", "succeeded", "2024-01-01 01:00:01")], schema).withColumn("at", F.col("at").cast("timestamp"))
    made.coalesce(1).write.parquet(f"{tmp_path}/r")
    with rocks(spark):
        states = flows.run_states(spark.readStream.schema(made.schema).parquet(f"{tmp_path}/r"), stale_ms=1_000, timers=True)
        stream = states.writeStream.option("checkpointLocation", f"{tmp_path}/c").outputMode("append").format("parquet").trigger(processingTime="1 second").start(f"{tmp_path}/s")
        try:
            until, got = time.time() + 120, []
            while time.time() < until and ("a", "1", "expired") not in got:
                assert stream.exception() is None, str(stream.exception())[:6000]
                time.sleep(1)
                got = [tuple(r) for r in spark.read.schema("key string, run string, state string").parquet(f"{tmp_path}/s").collect()] if sinks.exists(spark, f"{tmp_path}/s/_spark_metadata") else []
        finally:
            stream.stop()
    assert sorted(got) == [("a", "1", "expired"), ("a", "1", "running"), ("b", "2", "running"), ("b", "2", "succeeded")]


def test_column_subsets_and_shards(spark, tmp_path):
    t = spark.range(20).select("id", F.lit("x,y").alias("s"), F.lit(None).cast("string").alias("n"))
    t.coalesce(1).write.option("header", True).csv(f"{tmp_path}/t.csv")
    got = readers.read_any(spark, f"{tmp_path}/t.csv", columns=["s", "id"])
    assert got.dtypes == [("s", "string"), ("id", "string")] and got.count() == 20 and got.first().s == "x,y"
    with pytest.raises(ValueError, match="gone"):
        readers.read_any(spark, f"{tmp_path}/t.csv", columns=["id", "gone"])
    for i in range(3):
        t.filter(f"id % 3 = {i}").coalesce(1).write.parquet(f"{tmp_path}/shard-{i}")
    assert sorted(r.id for r in readers.read_shards(spark, f"{tmp_path}/shard-*", 3).collect()) == list(range(20))
    with pytest.raises(ValueError):
        readers.read_shards(spark, f"{tmp_path}/shard-*", 4)


def test_cells_of_pages_with_their_numbers(spark):
    page = "<table id=a><tr><th>H</th></tr><tr><td data-stat=n>1,234.5</td><td csk='-7'>minus</td><td>1,2x</td><td>.5</td></tr></table><!-- <table><tr><td>é &amp; 3</td></tr></table> -->"
    t = spark.createDataFrame([(1, page), (2, None), (3, "none"), (4, "<table><tr><td>1e3</td><table id=in><tr><td>5</td></tr></table></tr></table>")], "k int, html string")
    got = sorted((r.k, r.table_id, r.row, r.cell, r.name, r.value, r.number) for r in readers.table_cells(t, "html").collect())
    assert got == [(1, "", 0, 0, "", "é & 3", None), (1, "a", 0, 0, "", "H", None), (1, "a", 1, 0, "n", "1,234.5", 1234.5), (1, "a", 1, 1, "", "-7", -7.0), (1, "a", 1, 2, "", "1,2x", None), (1, "a", 1, 3, "", ".5", 0.5), (4, "", 0, 0, "", "1e3", 1000.0), (4, "in", 0, 0, "", "5", 5.0)]


def test_kinds_are_those_of_the_json(spark):
    docs = spark.createDataFrame([('{"a": "12", "b": "true", "é\\"x": null}',), ('{"a": 1.5, "b": [], "c": {}}',), ("[1]",), ("not json",), (None,), ("{}",), ('{"c": false}',)], "d string")
    assert audits.schema_fingerprint(docs, "d").first().shape == '[["a",["number","string"]],["b",["array","string"]],["c",["boolean","object"]],["é\\"x",["null"]]]'
    assert audits.schema_fingerprint(docs.limit(0), "d").first().shape == "[]"


def test_notes_of_warnings(spark):
    two, role, stale = "two_way_target_not_preregistered_forecast_withheld", "current_role_transition_forecast_withheld", "stale_return_feature_state_forecast_withheld"
    rows = [
        (1, "active", "Hitter", True, True, [stale, role, role], False, False), (2, "active", "Two-way", True, True, [two], False, False), (3, "active", "Hitter", True, True, ["research_only"], False, True), (4, "recent_callup", "Hitter", False, False, None, True, False),
        (5, "active", "Hitter", False, True, [], False, False), (6, "post_debut_minors", "Pitcher", False, False, None, False, True),
    ]
    t = spark.createDataFrame(rows, "i int, stage string, kind string, held boolean, there boolean, ws array<string>, prior boolean, idless boolean")
    c = F.col
    got = {r.i: r.n for r in t.select("i", roster.handling_codes(c("stage"), c("kind"), c("held"), c("there"), c("ws"), c("prior"), c("idless")).alias("n")).collect()}
    assert got == {
        1: "role_transition_model_scope,stale_return_features", 2: "two_way_model_scope", 3: "identity_link_missing,forecast_withheld_other", 4: "rookie_prior_unmatched,forecast_not_available", 5: "", 6: "post_debut_minor_assignment,identity_link_missing",
    }


def test_lines_through_points(spark):
    xs, ys = [1.0, 2.0, 2.0, 5.0], [10.0, 0.0, 4.0, 7.0]
    t = spark.createDataFrame([(float(x),) for x in (0, 1, 1.25, 2, 3.5, 5, 9)] + [(None,)], "x double")
    points = lambda v: F.array(*[F.lit(p) for p in v])
    got = {r.x: r.y for r in t.select("x", numbers.interpolated(F.col("x"), points(xs), points(ys)).alias("y")).collect()}
    assert got.pop(None) is None and all(y == pytest.approx(np.interp(x, xs, ys)) for x, y in got.items())
    one = t.select(numbers.interpolated(F.col("x"), points([1.0]), points([3.0])).alias("y"), numbers.interpolated(F.col("x"), points(xs), points([1.0])).alias("z")).collect()
    assert {r.y for r in one} == {3.0, None} and {r.z for r in one} == {None}
    mixed = models.mixture_quantiles(spark.createDataFrame([(0.2, [1.0, 2.0, 3.0]), (0.0, [1.0, 2.0, 3.0]), (1.0, [1.0, 2.0, 3.0])], "z double, p array<double>"), "z", "p", (0.1, 0.5, 0.9), "q")
    assert [[round(v, 6) for v in r.q] for r in mixed.orderBy("z").collect()] == [[1.0, 2.0, 3.0], [0.0, round(float(np.interp(0.375, (0.1, 0.5, 0.9), (1, 2, 3))), 6), round(float(np.interp(0.875, (0.1, 0.5, 0.9), (1, 2, 3))), 6)], [0.0, 0.0, 0.0]]


def test_seasons_by_the_names_of_their_source(spark):
    t = spark.createDataFrame([("p", "1990", " Complete ", "70", "750", "x"), ("q", "1991", None, "x", None, "Hitter")], "playerID string, yearID string, seasonState string, pa string, ipouts string, role string")
    got = {r.entity: r for r in panel.season_rows(t).collect()}
    assert (got["p"].season, got["p"].season_state, got["p"].role, got["p"].b_war) == (1990, "complete", "pitcher", None) and (got["q"].season_state, got["q"].b_pa, got["q"].role) == ("complete", None, "hitter")
    with pytest.raises(ValueError, match="entity"):
        panel.season_rows(t.drop("playerID"))


def test_roles_of_all_rows_together(spark):
    rows = [(1, 15, 40.0, 30, "2B/P", None), (1, 10, 40.0, 40, None, None), (2, 30, 90.0, 0, "P/SS", None), (3, 30, 90.0, 90, "P", None), (4, 1, 2.0, 0, "UNK", None), (5, 0, None, None, None, " Pitcher"), (6, 0, 0.0, 0, "", "x"), (7, 0, 0.0, 0, None, "hitter"), (7, 0, 0.0, 0, None, "pitcher")]
    t = spark.createDataFrame(rows, "id int, g int, b double, o int, p string, r string")
    assert {r.id: r.role for r in careers.aggregate_roles(t, ["id"], "g", "b", "o", "p", "r").collect()} == {1: "two_way", 2: "hitter", 3: "pitcher", 4: "hitter", 5: "pitcher", 6: None, 7: None}
