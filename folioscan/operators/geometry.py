"""Facts that need boxes: captures with layout, reading order, occlusion, labels, emphasis.

Rows have (capture_id, node, parent, end, path, kind, tag, text, box struct<x,y,w,h>, paint,
style struct) as ``sources.captures`` makes them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import colour
from folioscan.operators import folds, tree

CELL = 256.0
NEAR, ABOVE, BELOW, MARGIN = 160.0, 24.0, 32.0, 6.0


def overlap(a: Column, b: Column) -> Column:
    """Boxes share a point inside both; edges that touch don't count."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def is_empty(b: Column) -> Column:
    return (b["w"] <= 0) | (b["h"] <= 0)


def _line_of(state: tuple[int, float, float], y: float, h: float) -> tuple[tuple, tuple]:
    """The line a box joins, boxes coming from the top: the present one while its top lies above
    half the lesser of its height and that of the line's first box, each one pixel at least."""
    line, top, height = state
    if line >= 0 and y < top + min(max(height, 1.0), max(h, 1.0)) / 2:
        return state, (line,)
    return (line + 1, y, h), (line + 1,)


def box_lines(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``df`` with ``row``, the line on which its box stands among those of ``by``."""
    tall = df.withColumns({"_y": F.col("box.y").cast("double"), "_h": F.col("box.h").cast("double")})
    return folds.scan(tall, by, ("_y", "node"), ("_y", "_h"), lambda: (-1, 0.0, 0.0), _line_of, "row int").drop("_y", "_h")


def reading_order(df: DataFrame, by: tuple[str, ...] = ("capture_id", "parent")) -> DataFrame:
    """``df`` with (row, pos) among siblings: rows top-down, then left to right."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy("row", "box.x", "box.y", "node")) - 1
    return box_lines(df, by).withColumn("pos", at)


def offscreen(df: DataFrame, captures: DataFrame) -> DataFrame:
    """``df`` with ``offscreen``: a box wholly outside its capture's scrollable extent."""
    b = F.col("box")
    out = (b["x"] + b["w"] <= 0) | (b["y"] + b["h"] <= 0) | (b["x"] >= F.col("content_w")) | (b["y"] >= F.col("content_h"))
    return df.join(captures.select("capture_id", "content_w", "content_h"), "capture_id").withColumn("offscreen", ~is_empty(b) & out).drop("content_w", "content_h")


def occluded(df: DataFrame) -> DataFrame:
    """(capture_id, node, coverer): boxes whose centre and four corners, one pixel inside, all
    lie in boxes painted later that are neither above nor below them in the tree; boxes under
    four pixels wide or high count by the centre. The coverer is the top paint at the centre.

    A cover stands on the four cells at most that it touches in the grid whose cells are as
    large as it is; a box is looked up once in each cell that holds a point of it, in each grid
    that its capture's covers use, so only boxes near each other are compared. Points are made
    after the shuffles and counted as bits of a mask.
    """
    b = F.col("box")
    cell = lambda x, y: F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))
    left, right, top, bottom = b["x"] + 1, b["x"] + b["w"] - 1, b["y"] + 1, b["y"] + b["h"] - 1
    centre, corners = (b["x"] + b["w"] / 2, b["y"] + b["h"] / 2), [(left, top), (right, top), (left, bottom), (right, bottom)]
    small = (b["w"] < 4) | (b["h"] < 4)
    cover = df.where("paints").where(~is_empty(b)).select("capture_id", F.col("node").alias("c"), F.col("end").alias("c_end"), F.col("paint").alias("c_paint"), F.col("box").alias("c_box"))
    c = F.col("c_box")
    cover = cover.withColumn("grid", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(c["w"], c["h"]) / CELL))))
    size = CELL * F.pow(F.lit(2.0), F.col("grid"))
    grids = cover.groupBy("capture_id").agg(F.collect_set("grid").alias("_grids"))
    cells = lambda lo, length: F.explode(F.sequence(F.floor(lo / size), F.floor((lo + length) / size)))
    cover = cover.withColumn("cx", cells(c["x"], c["w"])).withColumn("cy", cells(c["y"], c["h"]))
    boxes = df.where(~is_empty(b)).select("capture_id", "node", "end", "path", "paint", "box").join(grids, "capture_id").withColumn("grid", F.explode("_grids"))
    met = F.when(small, F.array(cell(*centre))).otherwise(F.array_distinct(F.array(*[cell(*p) for p in (centre, *corners)])))
    spots = boxes.select("capture_id", "node", "end", "path", "paint", "box", "grid", F.inline(met))
    inside = lambda x, y: (x >= c["x"]) & (x < c["x"] + c["w"]) & (y >= c["y"]) & (y < c["y"] + c["h"])
    bit = lambda i, p: F.when(inside(*p), 1 << i).otherwise(0)
    mask = bit(0, centre).bitwiseOR(F.when(small, 0).otherwise(reduce(Column.bitwiseOR, [bit(i, p) for i, p in enumerate(corners, 1)])))
    apart = ~((F.col("c") < F.col("end")) & (F.col("c") >= F.col("node"))) & ~F.array_contains("path", F.col("c"))
    hits = spots.join(cover, ["capture_id", "grid", "cx", "cy"]).where((F.col("c_paint") > F.col("paint")) & apart).withColumns({"_mask": mask, "need": F.when(small, 1).otherwise(31)}).where("_mask > 0")
    on_top = F.max_by("c", F.when(F.col("_mask") % 2 == 1, F.struct("c_paint", -F.col("c"))))
    done = hits.groupBy("capture_id", "node").agg(F.bit_or("_mask").alias("met"), F.first("need").alias("need"), on_top.alias("coverer"))
    return done.where("met = need").select("capture_id", "node", "coverer")


def _reach_pairs(controls: DataFrame, texts: DataFrame, distance: Column) -> DataFrame:
    """(capture_id, control, label, dist): pairs of controls (node, box as a) and texts (node,
    box as b) for which ``distance`` is not null. Both stand on the grid cells they touch,
    controls with NEAR px to the left and ABOVE px below and above, texts on the cells of their
    left and right ends, so only boxes near each other meet."""
    cells = lambda lo, hi: F.sequence(F.floor(lo / CELL), F.floor(hi / CELL))
    a, b = F.col("a"), F.col("b")
    c = controls.withColumnsRenamed({"node": "control", "box": "a"}).withColumn("cy", F.explode(cells(a["y"] - BELOW, a["y"] + a["h"] + BELOW)))
    c = c.withColumn("cx", F.explode(cells(a["x"] - NEAR, a["x"] + a["w"] + ABOVE)))
    t = texts.withColumnsRenamed({"node": "label", "box": "b"}).withColumn("cy", F.explode(cells(b["y"], b["y"] + b["h"])))
    t = t.withColumn("cx", F.explode(F.array_distinct(F.array(F.floor(b["x"] / CELL), F.floor((b["x"] + b["w"]) / CELL)))))
    met = c.join(t, ["capture_id", "cx", "cy"]).withColumn("dist", distance).where("dist is not null")
    return met.groupBy("capture_id", "control", "label").agg(F.min("dist").alias("dist"))


def _mutual(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest, with the runner-up on either side MARGIN px farther."""

    def winner(key: str, other: str, flag: str, df: DataFrame) -> DataFrame:
        w = Window.partitionBy("capture_id", key).orderBy("dist", other)
        clear = F.coalesce(F.lead("dist").over(w) - F.col("dist") >= MARGIN, F.lit(True))
        return df.withColumn(flag, (F.row_number().over(w) == 1) & clear)

    both = winner("label", "control", "_b", winner("control", "label", "_a", pairs))
    return both.where("_a and _b").select("capture_id", "control", "label")


def _level(a: Column, b: Column) -> Column:
    """Boxes on one line: they share half the lesser height."""
    least = F.least(a["h"], b["h"])
    return (least > 0) & (F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]) >= 0.5 * least)


def ends_sentence(s: Column) -> Column:
    t = F.rtrim(s)
    return (t.endswith(".") & ~t.endswith("..")) | t.endswith("!") | t.endswith("?")


def label_pairs(controls: DataFrame, texts: DataFrame) -> DataFrame:
    """(capture_id, control, label): text left of a control, right of a toggle, or above, each
    the other's nearest by MARGIN px.

    ``controls`` has (capture_id, node, box, role, name), ``texts`` (capture_id, node, box, text,
    tone). Red texts are no labels, nor are sentences beside a control that has a name.
    """
    a, b = F.col("a"), F.col("b")
    left = F.when(_level(a, b) & (a["x"] - (b["x"] + b["w"])).between(-2, NEAR), a["x"] - (b["x"] + b["w"]))
    toggles = F.col("role").isin("checkbox", "radio", "switch")
    right = F.when(toggles & _level(a, b) & (b["x"] - (a["x"] + a["w"])).between(-2, ABOVE), b["x"] - (a["x"] + a["w"]))
    dx, gap = F.abs(b["x"] - a["x"]), a["y"] - (b["y"] + b["h"])
    above = F.when(gap.between(-2, ABOVE) & (dx <= 24), gap + 0.25 * dx)
    fits = (F.coalesce("tone", F.lit("")) != "red") & ~((F.coalesce("name", F.lit("")) != "") & ends_sentence(F.col("text")))
    return _mutual(_reach_pairs(controls.select("capture_id", "node", "box", "role", "name"), texts.select("capture_id", "node", "box", "text", "tone"), F.when(fits, F.coalesce(left, right, above))))


def error_pairs(controls: DataFrame, texts: DataFrame) -> DataFrame:
    """(capture_id, control, label): red text right below a field that explains it, each the
    other's nearest by MARGIN px; text on the line of another field belongs to that one."""
    a, b = F.col("a"), F.col("b")
    c, t = controls.select("capture_id", "node", "box"), texts.where("tone = 'red'").select("capture_id", "node", "box")
    gap, dx = b["y"] - (a["y"] + a["h"]), F.abs(b["x"] - a["x"])
    below = F.when(gap.between(-2, BELOW) & ((dx <= 24) | ((b["x"] >= a["x"]) & (b["x"] < a["x"] + a["w"]))), gap + 0.25 * F.least(dx, F.lit(24.0)))
    reach = _reach_pairs(c, t, below)
    wide = c.withColumn("box", F.struct((F.col("box.x") - NEAR).alias("x"), F.col("box.y").alias("y"), (F.col("box.w") + 2 * NEAR).alias("w"), F.col("box.h").alias("h")))
    on_row = _reach_pairs(wide, t, F.when(_level(a, b) & (F.greatest(a["x"] - (b["x"] + b["w"]), b["x"] - (a["x"] + a["w"])) <= 0), F.lit(0.0)))
    row_of = on_row.groupBy("capture_id", "label").agg(F.min("control").alias("_row"))
    return _mutual(reach.join(row_of, ["capture_id", "label"], "left").where("_row is null or _row = control").drop("_row"))


def median_size(texts: DataFrame, by: tuple[str, ...] = ("capture_id",), default: float = 16.0) -> DataFrame:
    """(by, size): the lower median font size weighted by characters."""
    sizes = texts.groupBy(*by, "size").agg(F.sum("weight").alias("w"))
    w = Window.partitionBy(*by)
    upto = F.sum("w").over(w.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = sizes.withColumn("upto", upto).withColumn("all", F.sum("w").over(w)).where(2 * F.col("upto") >= F.col("all"))
    return found.groupBy(*by).agg(F.coalesce(F.min("size"), F.lit(default)).alias("size"))


def dominant_colour(texts: DataFrame, by: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """(by, colour): the colour of most characters, ties to the least string."""
    w = Window.partitionBy(*by).orderBy(F.col("w").desc(), "colour")
    return texts.groupBy(*by, "colour").agg(F.sum("weight").alias("w")).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "colour")


def heading_level(size: Column, median: Column, bold: Column, chars: Column) -> Column:
    """Level of a text that stands out: 2, 1.6 and 1.3 times the median, or 1.15 and bold."""
    ratio = size / median
    return F.when(chars > 140, None).when(ratio >= 2, 1).when(ratio >= 1.6, 2).when(ratio >= 1.3, 3).when((ratio >= 1.15) & bold, 4)


def _reddish(h: Column) -> Column:
    return (h["s"] >= 0.5) & ((h["h"] <= 15) | (h["h"] >= 340))


def _greenish(h: Column) -> Column:
    return (h["s"] >= 0.4) & h["h"].between(85, 165)


def tone(c: Column, bg: Column, base: Column, base_bg: Column) -> Column:
    """red, green or muted text on its background, against the page's dominant text colour on
    its own; null where it is none of them, of the page's own tone, or half transparent."""
    shown = colour.over(c, bg)
    h, l = colour.hsl(shown), colour.hsl(shown)["l"]
    faint = (h["s"] <= 0.2) & (colour.distance(bg, base_bg) < 24)
    own, usual = colour.contrast(shown, bg), colour.contrast(colour.over(base, base_bg), base_bg)
    found = F.when(_reddish(h) & l.between(0.2, 0.7), "red").when(_greenish(h) & l.between(0.15, 0.65), "green").when(faint & (own >= 1.5) & (own < 0.4 * usual), "muted")
    b = colour.hsl(base)
    of_page = F.when(_reddish(b), "red").when(_greenish(b), "green").otherwise("")
    return F.when((c["a"] >= 0.5) & (found != of_page), found)


def unseen_text(fg: Column, bg: Column, size: Column, indent: Column) -> Column:
    """Text nobody can see: tiny, moved away, transparent, or of its backdrop's colour."""
    return (size <= 1) | (indent <= -500) | (fg["a"] <= 0.05) | (colour.contrast(colour.over(fg, bg), bg) < 1.1)


def primary_buttons(buttons: DataFrame) -> DataFrame:
    """(capture_id, parent, node): the one of sibling buttons whose fill stands out.

    ``buttons`` (capture_id, parent, node, fill, backdrop) are the visible ones that are not
    disabled; fill and backdrop are colours, and groups whose backdrop is unknown (null) have
    none. Of three or more it is the one farther than 24 from the others, which lie within
    12 of each other; else of two the one at least 80 farther from the backdrop.
    """
    shown = buttons.where("backdrop is not null").withColumn("_f", F.coalesce(colour.over(F.col("fill"), F.col("backdrop")), F.col("backdrop")))
    rgb = lambda c: F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))
    groups = shown.groupBy("capture_id", "parent").agg(F.array_sort(F.collect_list(F.struct("node", rgb(F.col("_f")).alias("f"), colour.distance(F.col("_f"), F.col("backdrop")).alias("d")))).alias("all"))
    others = lambda x: F.filter("all", lambda y: y["node"] != x["node"])

    def stands_out(x: Column) -> Column:
        rest = others(x)
        return F.forall(rest, lambda y: colour.distance(y["f"], F.get(rest, F.lit(0))["f"]) <= 12) & (colour.distance(x["f"], F.get(rest, F.lit(0))["f"]) > 24)

    odd = F.get(F.filter("all", stands_out), F.lit(0))["node"]
    a, b = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    pair = F.when(b["d"] > a["d"], F.when(b["d"] - a["d"] >= 80, b["node"])).when(a["d"] - b["d"] >= 80, a["node"])
    chosen = F.when(F.size("all") >= 3, odd).when(F.size("all") == 2, pair)
    return groups.select("capture_id", "parent", chosen.alias("node")).where("node is not null")


def visual_headings(blocks: DataFrame, medians: DataFrame) -> DataFrame:
    """(capture_id, node, level) of blocks that look like headings and are none by markup.

    ``blocks`` (capture_id, node, end, size, bold, chars, role, interactive, heading, hidden)
    are elements in document order; chars counts their own text. Parts of controls and of
    headings, marked or only looking so, are no headings of their own.
    """
    by = ("capture_id",)
    rows = blocks.join(medians.withColumnRenamed("size", "_median"), "capture_id")
    level = heading_level(F.col("size"), F.col("_median"), F.col("bold"), F.col("chars"))
    inside = tree.under(F.col("interactive") | F.col("heading"), by)
    plain = ~F.col("heading") & ~F.col("hidden") & ~F.col("interactive") & (F.col("role") == "") & (F.col("chars") > 0)
    rows = rows.withColumn("level", F.when(plain & ~inside, level))
    return rows.withColumn("_part", tree.under(F.col("level").isNotNull(), by)).where("level is not null and not _part").select("capture_id", "node", "level")


def scrollable(df: DataFrame) -> Column:
    """Boxes other than the page's own that scroll: their content is larger and may move."""
    moves = lambda axis: F.col(f"style.overflow_{axis}").isin("auto", "scroll")
    down = moves("y") & (F.col("scroll.h") > F.col("box.h") + 1)
    across = moves("x") & (F.col("scroll.w") > F.col("box.w") + 1)
    return F.coalesce(~F.col("tag").isin("html", "body") & (down | across), F.lit(False))


def table_rows(cells: DataFrame, by: tuple[str, ...] = ("capture_id", "table")) -> DataFrame:
    """(by, row, tsv): cells (by, node, text, box) as lines of a table, by where they stand. A
    row's cells go from left to right, one tab between them."""
    placed = box_lines(cells.where("trim(text) <> ''"), by)
    each = placed.groupBy(*by, "row").agg(F.array_sort(F.collect_list(F.struct("box.x", "node", "text"))).alias("c"))
    return each.select(*by, "row", F.array_join(F.transform("c", lambda c: c["text"]), "\t").alias("tsv"))


def modal_layers(df: DataFrame, captures: DataFrame) -> DataFrame:
    """(capture_id, node, covers, backdrop) of dialogs that lie over the page.

    ``df`` has (capture_id, node, parent, path, tag, role, hidden, aria_modal, position, box);
    ``captures`` the viewport. A dialog is modal when it says so, or when it is placed out of
    the flow and spans half the viewport, is a native one in the top layer, or has a backdrop:
    a large placed box among its three nearest wrappers, or beside it or one of them.
    """
    size = captures.select("capture_id", (F.col("viewport_w") * F.col("viewport_h")).alias("_vp"))
    rows = df.where("not hidden").join(size.hint("merge"), "capture_id")  # narrow, but one row each capture
    large = (F.col("_vp") > 0) & (F.col("box.w") * F.col("box.h") >= 0.5 * F.col("_vp"))
    rows = rows.withColumns({"_layered": F.coalesce(F.col("position").isin("fixed", "absolute"), F.lit(False)), "_large": F.coalesce(large, F.lit(False))}).hint("merge")
    dialogs = rows.where(F.col("role").isin("dialog", "alertdialog") & (F.col("aria_modal") | F.col("_layered")))
    ups = F.slice(F.reverse(F.concat("path", F.array("node"))), 1, 4)
    near = dialogs.select("capture_id", "node", "_layered", F.posexplode(ups).alias("deep", "up"))
    big = rows.where("_layered and _large").select("capture_id", F.col("node").alias("layer"), F.coalesce("parent", F.lit(-1)).alias("_parent"))
    wrappers = near.where("deep > 0").join(big.withColumnRenamed("layer", "up"), ["capture_id", "up"]).select("capture_id", "node", F.col("up").alias("layer"))
    parents = rows.select("capture_id", F.col("node").alias("up"), F.coalesce("parent", F.lit(-1)).alias("_parent"))
    beside = near.where("_layered").join(parents, ["capture_id", "up"]).join(big, ["capture_id", "_parent"]).where("layer <> up and layer <> node").select("capture_id", "node", "layer")
    backdrops = wrappers.unionByName(beside).groupBy("capture_id", "node").agg(F.min("layer").alias("backdrop"))
    native = (F.col("tag") == "dialog") & (F.col("position") == "fixed")
    covers = (F.col("_large") & F.col("_layered")) | native | F.col("backdrop").isNotNull()
    found = dialogs.join(backdrops, ["capture_id", "node"], "left").withColumn("covers", F.coalesce(covers, F.lit(False)))
    return found.where("aria_modal or covers").select("capture_id", "node", "covers", "backdrop")


def inert_behind(df: DataFrame, natives: DataFrame, covered: DataFrame, by: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """(by, node, coverer): ``covered`` (by, node, coverer) and all else outside the native
    dialog that is painted last, which lets no click through to what lies behind it.

    ``df`` (by, node, end, kind, tag, visible, box) are nodes, ``natives`` (by, node, end, paint)
    dialogs in the top layer. Neither what the dialog holds nor what holds it is behind it:
    what is left are two runs of document order, less the nodes whose subtree reaches it.
    """
    last = F.max_by(F.struct("node", "end"), F.struct("paint", -F.col("node"))).alias("top")
    top = natives.groupBy(*by).agg(last).select(*by, F.col("top.node").alias("coverer"), F.col("top.end").alias("_to"))
    boxes = df.where((F.col("kind") == "element") & F.col("visible") & ~is_empty(F.col("box")) & ~F.col("tag").isin("html", "body"))
    behind = boxes.join(top, list(by)).where((F.col("node") >= F.col("_to")) | (F.col("end") <= F.col("coverer"))).select(*by, "node", "coverer")
    return covered.select(*by, "node", "coverer").unionByName(behind.join(covered.select(*by, "node"), [*by, "node"], "left_anti"))


def layer_order(lines: DataFrame, dialogs: DataFrame, by: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """``lines`` (by, node, parent, end, indent) with (layer, pos, level): dialogs first, that
    painted last before the others, then the page.

    ``dialogs`` (by, node, paint) are lines of modal layers. A dialog's lines leave where they
    stand and follow it, less those of a dialog inside it, which is a layer of its own;
    ``layer`` is the dialog's node, null for the page, ``level`` the indent within the layer.
    """
    marked = lines.join(dialogs.select(*by, "node", F.col("paint").alias("_paint")), [*by, "node"], "left")

    def hand(above: tuple, paint: int | None, node: int, indent: int) -> tuple[tuple, tuple]:
        own = above if paint is None else (node, paint, indent)
        return own, (own[0], own[1], indent - own[2])

    inputs = ("_paint", "_line", "indent")
    rows = folds.handed_down(marked.withColumn("_line", F.col("node")), by, inputs, (None, None, 0), hand, "layer int, _of long, level int")
    order = Window.partitionBy(*by).orderBy(F.col("_of").desc_nulls_last(), F.coalesce("layer", F.lit(-1)), "node")
    return rows.withColumn("pos", F.row_number().over(order) - 1).drop("_paint", "_line", "_of")


def area_box(shape: Column, coords: Column, img: Column) -> Column:
    """The box of an image map's area on an image at ``img``; a shape that can't be read is the
    whole image."""
    parts = F.filter(F.split(F.trim(coords), r"[,\s]+"), lambda x: x != "")
    n = F.transform(parts, lambda x: x.try_cast("double"))
    bad = F.exists(n, lambda x: x.isNull())
    kind = F.lower(F.coalesce(shape, F.lit("")))
    box = lambda x0, y0, x1, y1: F.struct((img["x"] + x0).alias("x"), (img["y"] + y0).alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    xs, ys = F.filter(n, lambda x, i: i % 2 == 0), F.filter(n, lambda x, i: i % 2 == 1)
    xs = F.slice(xs, F.lit(1), F.size(ys))  # whole pairs alone
    at = lambda i: F.get(n, F.lit(i))
    circle = F.when(F.size(n) >= 3, box(at(0) - at(2), at(1) - at(2), at(0) + at(2), at(1) + at(2)))
    poly = F.when(F.size(n) >= 4, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    rect = F.when(F.size(n) >= 4, box(F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3))))
    found = F.when(kind.isin("circle", "circ"), circle).when(kind.isin("poly", "polygon"), poly).when(kind.isin("", "rect", "rectangle"), rect)
    whole = F.struct(img["x"].cast("double").alias("x"), img["y"].cast("double").alias("y"), img["w"].cast("double").alias("w"), img["h"].cast("double").alias("h"))
    return F.coalesce(F.when(~F.coalesce(bad, F.lit(True)), found), whole)


def map_nodes(nodes: DataFrame, by: str = "page_id") -> DataFrame:
    """The nodes that ``image_map_areas`` reads, in four branches: few of a page. Where nodes come
    from HTML these are to be written first, or each branch parses all pages anew."""
    return nodes.where(F.col("tag").isin("map", "img", "area")).select(by, "node", "parent", "tag", "attrs")


def image_map_areas(nodes: DataFrame, images: DataFrame, by: str = "page_id") -> DataFrame:
    """(by, node, image, box) of the areas with an address that images use: ``nodes`` with
    attrs, ``images`` (by, node, box). Of maps of one name the first counts."""
    attr = lambda name: F.col("attrs")[name]
    named = nodes.where("tag = 'map'").select(by, F.col("node").alias("map"), F.explode(F.array(attr("name"), attr("id"))).alias("name")).where("name <> ''").groupBy(by, "name").agg(F.min("map").alias("map"))
    uses = nodes.where((F.col("tag") == "img") & attr("usemap").isNotNull()).select(by, F.col("node").alias("image"), F.regexp_replace(attr("usemap"), "^#", "").alias("name"))
    areas = nodes.where((F.col("tag") == "area") & attr("href").isNotNull()).select(by, "node", F.col("parent").alias("map"), attr("shape").alias("_shape"), F.coalesce(attr("coords"), F.lit("")).alias("_coords"))
    met = uses.join(images.select(by, F.col("node").alias("image"), F.col("box").alias("_img")), [by, "image"]).join(named, [by, "name"]).join(areas, [by, "map"])
    return met.select(by, "node", "image", area_box(F.col("_shape"), F.col("_coords"), F.col("_img")).alias("box"))


def truncated(df: DataFrame) -> Column:
    """Text cut by an ellipsis or a line clamp."""
    cut = (F.col("style.text_overflow") == "ellipsis") & (F.col("scroll.w") > F.col("box.w") + 1)
    return F.coalesce(cut | ((F.col("style.line_clamp") != "none") & (F.col("scroll.h") > F.col("box.h") + 1)), F.lit(False))
