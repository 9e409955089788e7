"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 40) -> DataFrame:
    """(node, component): component is the smallest node reached over the edges.

    Rounds of large-star and small-star: each node's neighbours are tied to its smallest
    neighbour, which halves paths; hot nodes are met only by a ``min`` that combines on the
    map side and by joins that AQE can split. Each round is a written table, and the one
    before it is deleted. Null ends drop the edge, self-loops keep their node, repeated
    edges count once, and an empty table gives no rows.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = both.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = materialize(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        two = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        # a fixed point is a forest of stars: no node stands on both sides of an edge
        deep = after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        discard(now)
        now = after
        if not deep and after.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
