"""What has a row a node, a capture or a term joins by shuffles, however small its files look."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscan import catalog
from folioscan.operators import views
from folioscan.plans import kept

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["field_errors", "label_contradictions", "modal_layers", "named_targets", "form_names", "split_phrases"])
def test_broadcasts_nothing_that_grows(spark, name):
    assert "BroadcastExchange" not in plan_of(catalog.queries()[name](spark, SF))


def test_terms_that_share_their_words_meet_where_they_differ(spark):
    sized = spark.range(3000).select(F.concat(F.lit("shown words of "), "id").alias("term")).select("term", F.col("term").alias("_low"), F.lit(16).alias("_size"))
    asked = views._asked(sized, [16])
    assert asked.count() == 3000
    assert asked.groupBy("_key").count().agg(F.max("count")).first()[0] <= 12


def test_holding_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "gamma ray", "of", "a", "12", "straße", "😀b", "long phrase of many words"]
    texts = [(k, k % 3, " ".join(rng.choices(words, k=rng.randrange(9))).lower()) for k in range(120)]
    terms = ["", "a", "of", "OF A", "12 1", "beta", "Beta Beta", "😀b", "😀", "aße st", "gamma ray of", "phrase of many words", "long phrase of many words of", "none", "x" * 20]
    df = spark.createDataFrame(texts, "page_id long, node int, t string")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted((r.page_id, r.term) for r in views._holding(df, asked).collect())
    assert got == sorted((p, t) for p, _, s in texts for t in terms if t and t.lower() in s)
    assert views._holding(df, asked.where("term = ''")).count() == 0


@pytest.mark.parametrize("name", ["form_names", "label_contradictions"])
def test_names_are_planned_once(spark, name):
    assert plan_of(catalog.queries()[name](spark, SF)).count("SortMergeJoin") <= 16


@pytest.mark.parametrize("name", ["form_states", "role_counts"])
def test_facts_are_dealt_out_however_well_they_pack(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert "hashpartitioning(page_id" in plan and "REPARTITION_BY_NUM" in plan


def test_small_files_are_written_by_all_tasks(spark, monkeypatch, tmp_path):
    """A file a user is slow to make and small: tasks put together by bytes would be one."""
    monkeypatch.setattr(kept, "shared_path", lambda _, name: str(tmp_path / name))
    assert catalog.queries()["kept_files"](spark, SF).count() > 0
    assert len({f.name.split("-")[1] for f in tmp_path.rglob("part-*")}) > 1
