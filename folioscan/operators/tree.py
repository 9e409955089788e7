"""Questions about ancestors and subtrees, answered by windows over document order.

All take nodes with ``end``; ``by`` names the columns that tell pages apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators import folds


def _before(by: tuple[str, ...]):
    return Window.partitionBy(*by).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)


def after(by: tuple[str, ...] = ("page_id",)):
    """The rows behind a node. They are met from the last one on: a frame that ends at the last
    row is summed up anew for each row, which takes the square of a page."""
    return Window.partitionBy(*by).orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)


def holds(flag: Column, by: tuple[str, ...] = ("page_id",)) -> Column:
    """Whether a flagged node lies below: the next one in document order stands before the end."""
    return F.coalesce(F.min(F.when(flag, F.col("node"))).over(after(by)) < F.col("end"), F.lit(False))


def under(flag: Column, by: tuple[str, ...] = ("page_id",)) -> Column:
    """True where an ancestor has ``flag``: a node lies in a subtree iff the greatest end of
    the flagged nodes before it is beyond it. One sort, no join."""
    return F.coalesce(F.max(F.when(flag, F.col("end"))).over(_before(by)) > F.col("node"), F.lit(False))


def nearest(flag: Column, value: Column, by: tuple[str, ...] = ("page_id",)) -> Column:
    """``value`` of the nearest flagged ancestor of a kind that never holds itself, as links."""
    last = F.last(F.when(flag, F.struct(F.col("end").alias("e"), value.alias("v"))), ignorenulls=True).over(_before(by))
    return F.when(last["e"] > F.col("node"), last["v"])


def subtree_count(df: DataFrame, flag: Column, name: str, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``df`` with the number of flagged nodes below each node, from prefix sums."""
    w = Window.partitionBy(*by).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = df.withColumn("_cum", F.sum(flag.cast("long")).over(w))
    ends = cum.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("node").alias("_last"), F.col("_cum").alias("_upto"))
    on = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("end") - 1 == F.col("_last")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return cum.join(ends, cond, "left").withColumn(name, F.coalesce(F.col("_upto") - F.col("_cum"), F.lit(0)).cast("long")).drop("_cum", "_last", "_upto", *[f"_{c}" for c in by])


def innermost(matches: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Matches that hold no other match: the next one in document order lies beyond their end."""
    following = F.lead("node").over(Window.partitionBy(*by).orderBy("node"))
    return matches.withColumn("_next", following).where("_next is null or _next >= end").drop("_next")


def text_of(nodes: DataFrame, roots: DataFrame, by: tuple[str, ...] = ("page_id",), gap: Column | None = None) -> DataFrame:
    """(by, root, content): the texts below each root, in order, cleaned by the caller.

    ``nodes`` are the readable text rows with ``path``; only their ancestors among ``roots``
    (by, root) are met, so a text is repeated once for each named root above it. Both sides
    have a row a node and may look small packed in files, so joins of them shuffle.
    """
    each = nodes.select(*by, "node", "piece", F.explode("path").alias("root")).hint("merge").join(roots.select(*by, "root"), [*by, "root"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "piece"))), lambda x: x["piece"]), "")
    return each.groupBy(*by, "root").agg(ordered.alias("content")).hint("merge")


def position_paths(nodes: DataFrame, by: tuple[str, ...] = ("page_id",), levels: int = 5) -> DataFrame:
    """``nodes`` with ``position``: tag and number among the siblings of that tag, of the node and
    of those above it, ``levels`` in all, innermost first."""
    same = F.row_number().over(Window.partitionBy(*by, F.coalesce("parent", F.lit(-1)), "tag").orderBy("node")) - 1
    rows = nodes.withColumn("_part", F.concat("tag", F.lit(":"), F.when(F.col("parent").isNull(), 0).otherwise(same).cast("string")))

    def hand(above: tuple, part: str) -> tuple[tuple, tuple]:
        own = (part, *above)[:levels]
        return own, ("/".join(own),)

    return folds.handed_down(rows, by, ("_part",), (), hand, "position string").drop("_part")
