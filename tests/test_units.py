from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.functions import numbers, safe, text
from pitwise.operators import checks, identity, ordered, survival
from pitwise.plans import models
from pitwise.sources import readers, sinks
from pitwise.streaming import flows


def test_checked_join_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(identity.CardinalityError):
        identity.checked_join(a, b, ["k"])
    assert identity.checked_join(a, b.limit(1), ["k"]).count() == 2


def test_pool_adjacent_is_monotone_and_keeps_the_mean():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 40):
        v, w = r.normal(size=n), r.uniform(0.1, 2, size=n)
        out = ordered.pool_adjacent(v, w)
        assert (np.diff(out) >= -1e-12).all() and np.isclose((out * w).sum(), (v * w).sum())


def test_labels_at_the_very_horizon_and_under_censoring(spark):
    rows = [(1, "2020-01-31", "2021-01-31"), (2, "2020-01-31", "2021-02-01"), (3, "2020-06-30", None), (4, "2020-01-01", "2019-12-31")]
    t = spark.createDataFrame(rows, "id int, a string, e string").select("id", F.col("a").cast("date").alias("a"), F.col("e").cast("date").alias("e"))
    got = {r.id: r for r in survival.censored_labels(t, "a", "e", F.lit("2021-06-30").cast("date"), (12, 24)).collect()}
    assert (got[1].event_12m, got[2].event_12m, got[2].event_24m) == (True, False, True)
    assert (got[3].observed_12m, got[3].event_12m, got[3].observed_24m, got[3].event_24m) == (True, False, False, None)
    assert got[4].quarantine and got[4].event_12m is None


def test_contracts(spark):
    t = spark.createDataFrame([(1, 2)], "a int, b int")
    assert checks.exact_columns(t, ["b", "a"]) is t
    with pytest.raises(checks.ContractError):
        checks.exact_columns(t, ["a"])
    with pytest.raises(checks.ContractError):
        checks.no_leaks(["age", "debut_year"], ("debut", "future"))
    assert checks.rows_needed(1000, 100) == 600 and checks.rows_needed(10, 100) == 100


def test_scalars(spark):
    t = spark.createDataFrame([("12.1", "José O'Neil-Smith Jr."), ("7.3", None), (None, "")], "inn string, name string")
    got = t.coalesce(1).select(numbers.innings_to_outs(F.col("inn")).alias("o"), text.search_key(F.col("name")).alias("k"), text.person_name(F.col("name")).alias("n")).collect()
    assert [r.o for r in got] == [37, None, None] and got[0].k == "jose oneil smith jr"
    d = spark.createDataFrame([(2024, 2, 29), (2023, 2, 29)], "y int, m int, d int").select(safe.date_or_null(F.col("y"), F.col("m"), F.col("d")).alias("x"))
    assert [r.x is not None for r in d.collect()] == [True, False]


def test_embedded_texts(spark):
    page = 'x = 1; var rows =  [{"a": "]}\\"; [", "b": [1, 2]}, 3] ; rest <script id="__NEXT_DATA__" type="x">{"p": 1}</script>'
    assert readers.array_after(page, "var rows =") == ('[{"a": "]}\\"; [", "b": [1, 2]}, 3]', None)
    wrong = {"no such": "marker", "a = [1]; a = [2];": "marker", "a = {};": "no_array", "a = [1, [2];": "unterminated", 'a = ["x];': "unterminated", "a = [1]": "no_terminator", "a = ['x'];": "invalid"}
    assert {t: readers.array_after(t, "a =")[1] for t in wrong} == wrong
    t = spark.createDataFrame([(page,), (None,)], "p string")
    got = t.select(readers.embedded_json(F.col("p")).alias("j"), readers.embedded_array(F.col("p"), "var rows =").alias("a")).collect()
    assert got[0].j == '{"p": 1}' and got[0].a.startswith("[{") and got[1].a is None
    with pytest.raises(Exception, match="marker"):
        t.select(readers.embedded_array(F.col("p"), "var other =")).collect()
    assert t.select(readers.embedded_array(F.col("p"), "var other =", strict=False).alias("a")).filter("a is not null").count() == 0


def test_tables_in_cells(spark):
    page = "<table id=o><tr><td>a</td><td>b<table id=i><tr><td>x</td></tr></table>c</td><td>d</td></tr><tr><td>e</table>"
    got = readers.html_tables(spark.createDataFrame([(1, page)], "k int, page string"), "k", "page").collect()
    assert sorted((r.table_id, r.row, r.cell, r.value) for r in got) == [("i", 0, 0, "x"), ("o", 0, 0, "a"), ("o", 0, 1, "bc"), ("o", 0, 2, "d"), ("o", 1, 0, "e")]


def test_html_tables_in_comments(spark):
    page = '<table id="a"><tr><td data-stat="x" csk="5">five</td></tr></table><!-- <table id="b"><tr><th>h</th></tr></table> -->'
    got = readers.html_tables(spark.createDataFrame([(1, page), (2, None)], "k int, page string"), "k", "page").collect()
    assert [(r.table_id, r.name, r.value) for r in got] == [("a", "x", "5"), ("b", "", "h")]


def test_readers_by_suffix(spark, tmp_path):
    t = spark.createDataFrame([(1, "a,\"b\""), (2, None)], "k int, v string")
    t.write.option("header", True).csv(f"{tmp_path}/t.csv")
    t.write.json(f"{tmp_path}/t.jsonl")
    t.repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    assert readers.read_any(spark, f"{tmp_path}/t.csv").count() == readers.read_any(spark, f"{tmp_path}/t.jsonl").count() == 2
    with pytest.raises(ValueError):
        readers.read_shards(spark, f"{tmp_path}/t.parquet", 99)
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.unknown")


def test_sinks(spark, tmp_path):
    t = spark.range(10).withColumn("v", F.col("id") * 2)
    assert sinks.write_with_manifest(t, f"{tmp_path}/m")["rows"] == 10
    assert sinks.write_by_content(t, f"{tmp_path}/c") == sinks.write_by_content(t.repartition(3), f"{tmp_path}/c")
    path = f"{tmp_path}/p"
    assert sinks.publish(t, path, lambda x: x.count() == 10) and not sinks.publish(t.limit(3), path, lambda x: x.count() == 10)
    assert sinks.published(spark, path).count() == 10
    assert sinks.publish(t.limit(9), path, lambda x: True) and sinks.published(spark, path).count() == 9
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, f"{tmp_path}/none")
    sinks.ordered_csv(t.withColumn("a", F.lit(1)), ["v", "x"], f"{tmp_path}/o.csv")
    assert readers.read_any(spark, f"{tmp_path}/o.csv").columns == ["v", "a", "id"]
    assert readers.blobs(spark, f"{tmp_path}/o.csv/*.csv").filter("length(sha256) = 64 and bytes > 0").count() > 0
    lines = spark.createDataFrame([('﻿1,"a ""b"", c"\r',), ("2,x",)], "l string").select(readers.quoted_csv(F.col("l"), "n int, t string").alias("r")).select("r.*").collect()
    assert [(r.n, r.t) for r in lines] == [(1, 'a "b", c'), (2, "x")]


def test_landing_is_idempotent_and_gated(spark, tmp_path):
    schema, src, dst = "k long, v string", f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).write.parquet(src)
    flows.land(spark, src, schema, dst, f"{tmp_path}/cp", ["k"]).awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], schema).write.mode("append").parquet(src)
    flows.land(spark, src, schema, dst, f"{tmp_path}/cp", ["k"]).awaitTermination()
    flows.land(spark, src, schema, dst, f"{tmp_path}/cp2", ["k"]).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(dst).collect()) == [1, 2, 3]
    flows.land(spark, src, schema, f"{tmp_path}/none", f"{tmp_path}/cp3", ["k"], gate=lambda rows: rows.count() > 100).awaitTermination()
    assert not sinks.exists(spark, f"{tmp_path}/none")
    assert not flows.reclaim(spark, schema, f"{tmp_path}/none", ["k"], lambda rows: False)
    assert flows.reclaim(spark, schema, f"{tmp_path}/none", ["k"], lambda rows: rows.count() > 0)  # what the gate kept out is not lost
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/none").collect()) == [1, 2, 3]


def test_stale_runs_are_reclaimed(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    schema = "key string, run string, status string, at string"
    runs = [("a", "1", "running", at(1)), ("b", "2", "failed", at(5)), ("c", "3", "succeeded", at(1)), ("d", "4", "running", at(5))]
    made = lambda rows: spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp"))
    got = {r.key: r.claimable for r in flows.claimable_runs(made(runs), "key", "status", "at", F.lit("2024-01-01 05:30:00").cast("timestamp")).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for reports in ([("a", "1", "running", at(1)), ("b", "9", "running", at(1))], [("a", "2", "running", at(1)), ("b", "9", "succeeded", at(1))], [("a", "3", "running", at(4)), ("b", "8", "running", at(2))]):
            made(reports).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
            stream = flows.run_states(spark.readStream.schema(made(reports).schema).parquet(f"{tmp_path}/r"))
            stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").outputMode("append").format("parquet").trigger(availableNow=True).start(f"{tmp_path}/s").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = sorted((r.key, r.run, r.state) for r in spark.read.parquet(f"{tmp_path}/s").collect())
    assert got == [("a", "1", "reclaimed"), ("a", "1", "running"), ("a", "2", "refused"), ("a", "3", "running"), ("b", "8", "running"), ("b", "9", "running"), ("b", "9", "succeeded")]


def test_streamed_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    made = {
        "tumbling": lambda e, late: flows.windowed(e, "ts", "6 hours", None, ["event_type"], "value", late),
        "sliding": lambda e, late: flows.windowed(e, "ts", "30 days", "10 days", ["event_type"], "value", late),
        "session": lambda e, late: flows.sessions(e, "ts", "3 hours", ["user_id"], late),
    }
    for name, make in made.items():
        q = make(stream, "1 hour").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        round_ = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
        assert round_(spark.table(name).collect()) == round_(make(events, None).collect())


def test_calibration_moves_towards_the_outcomes(spark):
    r = np.random.default_rng(0)
    p = r.uniform(0.05, 0.95, 4000)
    y = (r.uniform(size=4000) < p**2).astype(int)
    t = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(p, y)], "g string, p double, y int")
    out = models.calibrated(t, models.calibrations(t, "g", "p", "y"), "g", "p", "q")
    b = out.agg(F.avg((F.col("p") - F.col("y")) ** 2), F.avg((F.col("q") - F.col("y")) ** 2)).first()
    assert b[1] < b[0]
    # a slope that would be negative is 0, and the intercept is then the best one there is
    y = r.integers(0, 2, 4000)
    x = np.where(y == 1, 0.2, 0.8)
    cold = (np.arange(4000) % 2).astype(float)
    a, s, c = models._fit(x, y.astype(float), np.ones(4000), cold)
    q = 1 / (1 + np.exp(-(a + c * cold)))
    assert s == 0 and abs((q - y).mean() + models.RIDGE * a) < 1e-6


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
