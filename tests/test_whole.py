from __future__ import annotations

import inspect

from pyspark.sql import functions as F
from test_oracle import SF

from pitwise import registry
from pitwise.functions import text
from pitwise.operators import cohorts
from pitwise.plans.catalog import table
from pitwise.sources import sinks


def test_whole_tables_reach_the_queries(spark, tmp_path):
    run = lambda name, at=SF: registry.queries()[name](spark, at)
    orders, customers, lines = (table(spark, SF, t) for t in ("orders", "customer", "lineitem"))
    assert run("merge_missing").count() == customers.count()
    assert run("json_recordset").count() == table(spark, SF, "events").count() and orders.count()
    assert run("resolve_identities").count() == orders.select("o_custkey").distinct().count()
    assert {r.k % 9 for r in run("manifest_errors").select("k").collect()} == set(range(9)) and lines.count()
    assert {r.a % 17 for r in run("one_to_one").collect()} == set(range(17))
    html = "<p>x</p><table id=t><tr><th data-stat=a>A</th></tr><tr><td data-stat=a csk=7>shown</td></tr></table><!--<table id=u><tr><td>é</td></tr></table>-->"
    pages = [(1, html), (2, None), (3, "no table"), (4, "<table><tr><td>z</td></tr></table>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted((r.page_id, r.row, r.cell, r.name, r.value) for r in run("page_tables", str(tmp_path)).collect())
    assert found == [(1, 0, 0, "", "é"), (1, 0, 0, "a", "A"), (1, 1, 0, "a", "7"), (4, 0, 0, "", "z")]


def test_entities_in_the_window_weigh_the_same(spark):
    rows = [("a", s, 5, 1.0) for s in (1, 2, 3)] + [("b", 1, 5, 9.0), ("t", 9, 5, 4.0)]
    t = spark.createDataFrame([("c", *r) for r in rows], "g string, e string, s int, age int, v double")
    standing = lambda **k: cohorts.adaptive_window_percentile(t.filter("e = 't'"), t, ["g"], "age", "v", "e", "s", least=2, **k).first()
    assert (standing().window, standing().percentile, standing(by_row=True).percentile) == (0, 50.0, 75.0)


def test_the_digest_of_a_table_is_summed_and_gathers_no_rows(spark):
    t = spark.range(50).withColumn("v", F.col("id") % 7)
    assert sinks.content_digest(t) == sinks.content_digest(t.repartition(5).orderBy("v"))
    others = [t.limit(49), t.union(t.limit(1)), t.withColumn("v", F.col("v") + 1), t.limit(0)]
    assert len({sinks.content_digest(x) for x in [t, *others]}) == 5
    assert "collect_list" not in inspect.getsource(sinks) + inspect.getsource(text)
