"""Kept state: site storage upserts, the newest sites, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_SITES = 50


def upsert_storage(kept: DataFrame, seen: DataFrame) -> DataFrame:
    """(name, origin, items, seen): new items replace old ones; equal items keep their time;
    sites that were not seen stay; an empty list is kept."""
    old = kept.select("name", "origin", F.col("items").alias("_old"), F.col("seen").alias("_seen"))
    both = old.join(seen, ["name", "origin"], "full_outer")
    same = F.col("items").isNull() | F.col("items").eqNullSafe(F.col("_old"))
    return both.select("name", "origin", F.coalesce("items", "_old").alias("items"), F.when(same, F.col("_seen")).otherwise(F.col("seen")).alias("seen"))


def newest_sites(storage: DataFrame, most: int = MOST_SITES) -> DataFrame:
    """The sites seen last of each name: the feature's own limit."""
    w = Window.partitionBy("name").orderBy(F.col("seen").desc(), "origin")
    return storage.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names whose state differs, so that only they are written again."""
    mark = lambda df, c: df.groupBy("name").agg(F.count("*").alias(f"n_{c}"), F.sum(F.xxhash64("origin", F.to_json(F.struct("items")), "seen").cast("decimal(38,0)")).alias(c))
    both = mark(before, "b").join(mark(after, "a"), "name", "full_outer")
    return both.where("not (a <=> b and n_a <=> n_b)").select("name")
