"""What several branches of a job ask for is made once, and lookups make few rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan import catalog
from folioscan.operators import changes, folds
from test_joins import SF, plan_of


def test_budgets_share_one_keep_order(spark, monkeypatch):
    calls = []
    gathered = folds.gathered
    monkeypatch.setattr(folds, "gathered", lambda *a: calls.append(a) or gathered(*a))
    out = catalog.queries()["outline_ratios"](spark, SF)
    assert len(calls) == 2  # the outline and one keep order
    assert out.where("fitted is null or tight is null or fitted > 240 or tight > 120 or tight > fitted").count() == 0


def test_pages_of_maps_are_parsed_once(spark):
    assert "MapInArrow" not in plan_of(catalog.queries()["image_maps"](spark, SF))


def test_covered_points_are_counted_in_one_aggregation(spark):
    assert plan_of(catalog.queries()["covered_items"](spark, SF)).count("SortAggregate") <= 2


def test_rebinding_reads_each_side_once(spark):
    key = ("link", "n", "a", "")
    lost = spark.createDataFrame([(1, 1, *key, "p"), (1, 2, "link", "x", "a", "", "p"), (1, 3, "link", "y", "a", "", "q"), (1, 4, "link", None, "a", "", "p")], "page_id long, ref long, role string, name string, tag string, stable string, position string")
    found = spark.createDataFrame([(1, 10, *key, "p"), (1, 11, *key, "q"), (1, 12, "link", "y", "a", "", "z")], "page_id long, node long, role string, name string, tag string, stable string, position string")
    out = changes.rebind(lost, found)
    assert {tuple(r) for r in out.select("ref", "node", "matches").collect()} == {(1, 10, 2), (2, None, 0), (3, 12, 1), (4, None, 0)}
    same = changes.rebind(lost.where("ref = 1"), found.withColumn("position", F.lit("p")))
    assert [tuple(r) for r in same.select("ref", "node", "matches").collect()] == [(1, None, 2)]
    assert plan_of(out).count("Scan ExistingRDD") == 2
