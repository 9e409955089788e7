"""What lies over a control that can't be reached, and whether that may clear by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.operators import tree

BY = ("capture_id",)
SHOWN_CHARS = 60


def reasons(covered: DataFrame, nodes: DataFrame, texts: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """``covered`` (by, node, coverer) with (why, may_clear, said).

    ``nodes`` (by, node, end, path, tag, role, ref, painted, box) hold both sides, ``texts``
    (by, node, path, text) what can be read. The cover is a ``frame``, a ``control`` with a
    ref, a ``text``, a ``layer`` that draws something at the target's centre, itself or by
    what holds it but not the target, or ``invisible``: a layer that nobody sees and that takes
    the click. Controls, texts and layers may clear by themselves unless a dialog holds them;
    a frame or an invisible layer is never waited out.
    """
    dialog = F.col("role").isin("dialog", "alertdialog")
    rows = nodes.withColumn("_dialog", dialog | tree.under(dialog, by))
    over = rows.select(*by, F.col("node").alias("coverer"), F.col("path").alias("_up"), F.col("tag").alias("_tag"), F.coalesce("ref", F.lit("")).alias("_ref"), "_dialog")
    below = rows.select(*by, "node", F.col("path").alias("_path"), F.col("box").alias("_box"))
    met = covered.select(*by, "node", "coverer").join(over, [*by, "coverer"]).join(below, [*by, "node"])
    roots = covered.select(*by, F.col("coverer").alias("root")).distinct()
    said = tree.text_of(texts.withColumn("piece", F.concat(F.lit(" "), "text")), roots, by).select(*by, F.col("root").alias("coverer"), text.clean(F.col("content")).alias("_said"))
    met = met.join(said, [*by, "coverer"], "left")
    steps = met.select(*by, "node", "coverer", (F.col("_box.x") + F.col("_box.w") / 2).alias("_x"), (F.col("_box.y") + F.col("_box.h") / 2).alias("_y"), F.explode(F.filter(F.concat("_up", F.array("coverer")), lambda p: ~F.array_contains("_path", p))).alias("_p"))
    drawn = rows.where("painted").select(*by, F.col("node").alias("_p"), F.col("box").alias("_b"))
    there = F.col("_x").between(F.col("_b.x"), F.col("_b.x") + F.col("_b.w")) & F.col("_y").between(F.col("_b.y"), F.col("_b.y") + F.col("_b.h"))
    shown = steps.join(drawn, [*by, "_p"]).where(there).select(*by, "node", "coverer").distinct().withColumn("_drawn", F.lit(True))
    met = met.join(shown, [*by, "node", "coverer"], "left")
    why = F.when(F.col("_tag") == "iframe", "frame").when(F.col("_ref") != "", "control").when(F.coalesce("_said", F.lit("")) != "", "text").when(F.col("_drawn"), "layer").otherwise("invisible")
    out = met.withColumn("why", why)
    clears = F.col("why").isin("control", "text", "layer") & ~F.col("_dialog")
    told = F.when(F.col("why") == "control", F.col("_ref")).when(F.col("why") == "text", text.clip(F.col("_said"), SHOWN_CHARS)).otherwise("")
    return out.select(*by, "node", "coverer", "why", clears.alias("may_clear"), told.alias("said"))
