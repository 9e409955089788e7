"""Dictionary-encoded captures (JSON) to node rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators import folds

# The style properties of a capture, in its order.
STYLE = "display visibility opacity position z_index overflow_x overflow_y color background_color font_size font_weight font_style text_decoration text_overflow white_space line_clamp cursor pointer_events clip_path float transform text_indent flex_direction order background_image background_clip".split()

_RARE_S, _RARE_I = "struct<index:array<int>,value:array<int>>", "struct<index:array<int>>"
SCHEMA = f"""struct<documents:array<struct<documentURL:int,title:int,scrollOffsetX:double,scrollOffsetY:double,contentWidth:double,contentHeight:double,
nodes:struct<parentIndex:array<int>,nodeType:array<int>,nodeName:array<int>,nodeValue:array<int>,backendNodeId:array<bigint>,attributes:array<array<int>>,isClickable:{_RARE_I},inputChecked:{_RARE_I},optionSelected:{_RARE_I},pseudoType:{_RARE_S},inputValue:{_RARE_S},textValue:{_RARE_S}>,
layout:struct<nodeIndex:array<int>,styles:array<array<int>>,bounds:array<array<double>>,paintOrders:array<int>,text:array<int>,scrollRects:array<array<double>>,blendedBackgroundColors:array<int>>>>,strings:array<string>>""".replace("\n", "")


def _said(i: Column) -> Column:
    """The string of an index; '' where the index is negative or out of range."""
    return F.coalesce(F.when(i >= 0, F.get(F.col("s"), i)), F.lit(""))


def _nodes(good: DataFrame, id_col: str) -> DataFrame:
    """What the dense arrays say: a node's strings are looked up before its row is made, so a
    row carries only its own."""
    at = lambda name, i: F.get(F.col(f"d.nodes.{name}"), i)
    pair = lambda a, j: F.struct(_said(F.get(a, j)).alias("key"), _said(F.get(a, j + 1)).alias("value"))
    attrs = lambda a: F.transform(F.filter(F.transform(a, lambda _, j: j), lambda j: (j % 2 == 0) & (j + 1 < F.size(a))), lambda j: pair(a, j))
    each = F.transform(
        "d.nodes.parentIndex",
        lambda p, i: F.struct(
            i.cast("int").alias("node"), F.when((p >= 0) & (p < i), p).alias("parent"), at("nodeType", i).alias("type"), _said(at("nodeName", i)).alias("name"), _said(at("nodeValue", i)).alias("dom_text"), at("backendNodeId", i).alias("backend"), F.coalesce(attrs(at("attributes", i)), F.array().cast("array<struct<key:string,value:string>>")).alias("pairs")
        ),
    )
    return good.select(id_col, F.inline(each))


def _marks(good: DataFrame, id_col: str) -> DataFrame:
    """What the sparse arrays say, by node: clickable, ticked, value, pseudo."""
    listed = lambda name, kind: F.transform(F.coalesce(F.col(f"d.nodes.{name}.index"), F.array().cast("array<int>")), lambda n, k: F.struct(n.alias("node"), k.cast("int").alias("at"), F.lit(kind).alias("kind"), F.lit("").alias("said")))
    valued = lambda name, kind: F.transform(F.coalesce(F.col(f"d.nodes.{name}.index"), F.array().cast("array<int>")), lambda n, k: F.struct(n.alias("node"), k.cast("int").alias("at"), F.lit(kind).alias("kind"), _said(F.get(F.col(f"d.nodes.{name}.value"), k)).alias("said")))
    every = F.concat(listed("isClickable", "clickable"), listed("inputChecked", "ticked"), listed("optionSelected", "ticked"), valued("inputValue", "a value"), valued("textValue", "b value"), valued("pseudoType", "pseudo"))
    rows = good.select(id_col, F.inline(every))
    last = lambda kinds: F.max_by(F.when(F.col("kind").isin(*kinds), F.col("said")), F.when(F.col("kind").isin(*kinds), F.struct("kind", "at")))
    return rows.groupBy(id_col, "node").agg(F.bool_or(F.col("kind") == "clickable").alias("clickable"), F.bool_or(F.col("kind") == "ticked").alias("ticked"), last(["a value", "b value"]).alias("value"), last(["pseudo"]).alias("pseudo"))


def _boxes(good: DataFrame, id_col: str) -> DataFrame:
    """What the layout says, by node; of several entries the last counts."""
    at = lambda name, k: F.get(F.col(f"d.layout.{name}"), k)
    box = lambda b: F.struct(*[F.when(F.size(b) == 4, F.get(b, F.lit(i))).alias(n) for i, n in enumerate("xywh")])
    style = lambda a: F.transform(a, lambda i: _said(i))
    each = F.transform("d.layout.nodeIndex", lambda n, k: F.struct(n.alias("node"), k.cast("int").alias("at"), F.struct(box(at("bounds", k)).alias("box"), style(at("styles", k)).alias("style"), at("paintOrders", k).alias("paint"), _said(at("text", k)).alias("text"), box(at("scrollRects", k)).alias("scroll"), _said(at("blendedBackgroundColors", k)).alias("background")).alias("laid")))
    return good.select(id_col, F.inline(each)).groupBy(id_col, "node").agg(F.max_by("laid", "at").alias("laid"))


def decode(raw: DataFrame, id_col: str = "capture_id", json_col: str = "capture") -> tuple[DataFrame, DataFrame]:
    """(nodes, rejected): node rows of the first document of each capture, and captures that
    have no document or no node. Short arrays read as absent values; a parent that does not
    come before its child is cut to none; indexes of no node are left out.

    A row carries its own strings alone, and what only some nodes have meets it by a join, so
    the work grows in proportion to a capture's nodes.
    """
    c = raw.select(id_col, F.from_json(json_col, SCHEMA, {"mode": "PERMISSIVE"}).alias("c"))
    one = c.select(id_col, F.get(F.col("c.documents"), F.lit(0)).alias("d"), F.col("c.strings").alias("s"))
    fine = F.coalesce(F.size("d.nodes.parentIndex") > 0, F.lit(False))
    rejected = one.where(~fine).select(id_col, F.when(F.col("d").isNull(), "no documents").otherwise("no nodes").alias("reason"))
    good = one.where(fine)
    rows = _nodes(good, id_col).join(_marks(good, id_col), [id_col, "node"], "left").join(_boxes(good, id_col), [id_col, "node"], "left")
    kind = F.when(F.col("type") == 1, "element").when(F.col("type") == 3, "text").when(F.col("type") == 9, "document").otherwise("other")
    keys = F.transform("pairs", lambda q: q["key"])
    first = F.filter("pairs", lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    dom = F.when(F.col("type") == 3, F.col("dom_text")).otherwise("")
    rect = lambda r: F.struct(*[F.coalesce(F.col(f"laid.{r}.{n}"), F.lit(0.0)).alias(n) for n in "xywh"])
    style = F.struct(*[F.coalesce(F.get(F.col("laid.style"), F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(STYLE)])
    out = rows.select(
        id_col, "node", "parent", kind.alias("kind"), F.when(F.col("type") == 1, F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("").alias("tag"),
        F.when(dom != "", dom).otherwise(F.coalesce("laid.text", F.lit(""))).alias("text"), F.map_from_entries(first).alias("attrs"), "backend",
        F.coalesce("clickable", F.lit(False)).alias("clickable"), F.coalesce("ticked", F.lit(False)).alias("ticked"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("pseudo", F.lit("")).alias("pseudo"),
        F.col("laid").isNotNull().alias("laid"), rect("box").alias("box"), F.coalesce("laid.paint", F.lit(0)).alias("paint"), style.alias("style"), rect("scroll").alias("scroll"), F.coalesce("laid.background", F.lit("")).alias("background"),
    )
    return out, rejected


def with_ends(nodes: DataFrame, id_col: str = "capture_id") -> DataFrame:
    """``nodes`` with ``end``, the exclusive end of each node's subtree."""
    return nodes.join(folds.intervals(nodes.select(id_col, "node", "parent"), (id_col,)), [id_col, "node"])
