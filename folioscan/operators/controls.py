"""Finding controls by name, what blocks them, error texts, struck-out text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.operators.facts import attr


def resolve(asked: DataFrame, controls: DataFrame) -> DataFrame:
    """``asked`` (query_id, page_id, text) with (outcome, node, matches).

    ``controls`` has (page_id, node, end, name, hidden). Visible controls of just that name
    come first, then of that name in any letter case, then hidden ones the same way; a match
    that holds another match is dropped. One match is found, several are ambiguous; where
    there is none, controls whose name holds the text are near misses.
    """
    q = asked.select("query_id", "page_id", text.clean(F.col("text")).alias("_text"))
    c = controls.select("page_id", "node", "end", "name", "hidden", F.lower("name").alias("_low"))
    same = q.withColumn("_low", F.lower("_text")).join(c, ["page_id", "_low"])
    rank = F.when(F.col("hidden"), 2).otherwise(0) + F.when(F.col("name") == F.col("_text"), 0).otherwise(1)
    best = same.withColumn("_rank", rank).withColumn("_least", F.min("_rank").over(Window.partitionBy("query_id"))).where("_rank = _least")
    following = F.lead("node").over(Window.partitionBy("query_id").orderBy("node"))
    inner = best.withColumn("_next", following).where("_next is null or _next >= end")
    exact = inner.groupBy("query_id").agg(F.count("*").alias("matches"), F.min("node").alias("node"))
    rest = q.join(exact, "query_id", "left_anti").join(c.drop("_low"), "page_id").where((F.col("_text") != "") & F.contains(F.lower("name"), F.lower("_text")) & ~F.col("hidden"))
    near = rest.groupBy("query_id").agg(F.count("*").alias("near"))
    out = asked.join(exact, "query_id", "left").join(near, "query_id", "left")
    outcome = F.when(F.col("matches") == 1, "found").when(F.col("matches") > 1, "ambiguous").when(F.col("near") > 0, "near").otherwise("not found")
    return out.withColumn("outcome", outcome).withColumn("node", F.when(F.col("outcome") == "found", F.col("node"))).withColumn("matches", F.coalesce("matches", "near", F.lit(0))).drop("near")


def blocked(controls: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """Controls that can't be used: (page_id, node, blocked_by, may_clear).

    ``controls`` has (page_id, node, hidden, disabled); ``covers`` (page_id, node, coverer,
    in_dialog) are those that something is painted over. A cover that is no dialog may clear
    by itself, as may a disabled state.
    """
    out = controls.select("page_id", "node", "hidden", "disabled")
    if covers is None:
        out = out.withColumns({"coverer": F.lit(None).cast("int"), "in_dialog": F.lit(None).cast("boolean")})
    else:
        out = out.join(covers.select("page_id", "node", "coverer", "in_dialog"), ["page_id", "node"], "left")
    why = F.when(F.col("hidden"), "hidden").when(F.col("disabled"), "disabled").when(F.col("coverer").isNotNull(), "covered-by")
    clears = F.col("disabled") & ~F.col("hidden") | F.col("coverer").isNotNull() & ~F.coalesce("in_dialog", F.lit(False))
    return out.withColumn("blocked_by", why).where("blocked_by is not null").withColumn("may_clear", F.coalesce(clears, F.lit(False))).select("page_id", "node", "blocked_by", "may_clear", "coverer")


def accepts(role: Column, readonly: Column, disabled: Column) -> Column:
    """What a field takes: typing, or why it takes none."""
    return F.when(~role.isin("textbox", "searchbox", "spinbutton", "combobox"), "not a field").when(disabled, "disabled").when(readonly, "read-only").otherwise("typable")


def error_texts(facts_df: DataFrame, readable_df: DataFrame) -> DataFrame:
    """(page_id, node, error): the first readable text of the element that a field's
    aria-errormessage names; of repeated ids the first counts."""
    ids = facts_df.where(attr("id") != "").select("page_id", attr("id").alias("id"), F.col("node").alias("root"), "end", F.row_number().over(Window.partitionBy("page_id", attr("id")).orderBy("node")).alias("_r")).where("_r = 1")
    asks = facts_df.where(attr("aria-errormessage").isNotNull()).select("page_id", "node", attr("aria-errormessage").alias("id"))
    texts = readable_df.where("kind = 'text'").select("page_id", F.col("node").alias("t"), text.clean(F.col("text")).alias("said")).where("said <> ''")
    below = asks.join(ids, ["page_id", "id"]).join(texts, "page_id").where("t > root and t < end")
    return below.groupBy("page_id", "node").agg(F.min_by("said", "t").alias("error"))


def struck(df: DataFrame, by: str = "capture_id") -> DataFrame:
    """``df`` with ``struck``: a line-through on the node or an ancestor, looking outward until
    a box that takes no decoration from outside (absolute, fixed, float, inline-block).

    Nodes have (by, node, path, style struct with text_decoration, position, float, display);
    a capture's styled nodes are one map, as large as a capture.
    """
    line = F.coalesce(F.contains(F.col("style.text_decoration"), F.lit("line-through")), F.lit(False))
    stop = F.coalesce(F.col("style.position").isin("absolute", "fixed") | (F.col("style.float") != "none") | (F.col("style.display") == "inline-block"), F.lit(False))
    marks = df.where(line | stop).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct(line.alias("line"), stop.alias("stop"))))).alias("_marks"))
    outward = F.reverse(F.concat("path", F.array("node")))

    def step(acc: Column, p: Column) -> Column:
        m = F.try_element_at("_marks", p)
        return F.struct((acc["hit"] | (~acc["done"] & F.coalesce(m["line"], F.lit(False)))).alias("hit"), (acc["done"] | F.coalesce(m["stop"], F.lit(False))).alias("done"))

    start = F.struct(F.lit(False).alias("hit"), F.lit(False).alias("done"))
    return df.join(marks, by, "left").withColumn("struck", F.when(F.col("_marks").isNotNull(), F.aggregate(outward, start, step)["hit"]).otherwise(False)).drop("_marks")
