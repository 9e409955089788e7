"""What a person can reach and read of a capture: off-screen and clipped boxes, backdrops,
unseen text.

Rows are nodes with (node, parent, end, kind, tag, text, hidden, laid, box, style, background)
as ``sources.captures`` makes them, ``hidden`` from the facts; ``by`` tells captures apart.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import colour, text
from folioscan.operators import folds, geometry, tree

BY = ("capture_id",)
_WHITE = (255.0, 255.0, 255.0)
# left, top: the greatest near edge that clips; right, bottom: the least far edge that clips
_OPEN = (float("-inf"), float("-inf"), float("inf"), float("inf"))


def _box_ok() -> Column:
    b = F.col("box")
    return F.col("laid") & ~geometry.is_empty(b) & ((b["w"] > 1) | (b["h"] > 1))


def _own_box() -> Column:
    """An element whose box can clip or scroll what it holds: not the page's own."""
    return (F.col("kind") == "element") & F.col("laid") & ~F.col("tag").isin("html", "body")


def clips_all(clip_path: Column) -> Column:
    """A clip-path that leaves nothing of the box."""
    return F.coalesce(clip_path.contains("inset(100%") | clip_path.contains("inset(50%") | clip_path.contains("circle(0"), F.lit(False))


def _clip_edges(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``df`` with ``_left``, ``_top``, ``_right``, ``_bottom``: the edges beyond which ancestors
    cut a box off. A fixed box belongs to the viewport, so nothing above it cuts it or what it
    holds: a node hands down its own edges joined to those above, or alone where it is fixed."""

    def hand(above: tuple, fixed: bool, x: float, y: float, w: float, h: float, cut_x: bool, cut_y: bool) -> tuple[tuple, tuple]:
        edges = _OPEN if fixed else above
        left, top, right, bottom = edges
        if cut_x:
            left, right = max(left, x), min(right, x + w)
        if cut_y:
            top, bottom = max(top, y), min(bottom, y + h)
        return (left, top, right, bottom), edges

    cuts = lambda axis: F.coalesce(_own_box() & F.col(f"style.overflow_{axis}").isin("hidden", "clip"), F.lit(False))
    rows = df.withColumns({"_fixed": F.coalesce(F.col("style.position") == "fixed", F.lit(False)), **{f"_{c}": F.col(f"box.{c}").cast("double") for c in "xywh"}, "_cut_x": cuts("x"), "_cut_y": cuts("y")})
    inputs = ("_fixed", "_x", "_y", "_w", "_h", "_cut_x", "_cut_y")
    return folds.handed_down(rows, by, inputs, _OPEN, hand, "_left double, _top double, _right double, _bottom double").drop(*inputs)


def reach(df: DataFrame, captures: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """``df`` with ``offscreen``, ``clipped`` and ``holds``.

    Off-screen boxes lie beyond the page (``captures`` has content_w, content_h, viewport_w,
    viewport_h) and inside no scroller that can be reached itself; a scroller can if it, or one
    above it, lies on the page. Clipped boxes are cut away by a clip-path of theirs or above,
    or lie wholly beyond the edge of an ancestor that clips, unless a fixed box stands between.
    A box that is either but holds something drawn in reach is neither: it ``holds``.
    """
    b = F.col("box")
    rows = _clip_edges(df, by).join(captures.select(*by, F.greatest("content_w", "viewport_w").alias("_pw"), F.greatest("content_h", "viewport_h").alias("_ph")), list(by))
    beyond = ((b["x"] + b["w"] <= 0) & (b["w"] > 0)) | (b["x"] + b["w"] < 0) | (b["y"] + b["h"] <= 0) | ((F.col("_pw") > 0) & (b["x"] >= F.col("_pw"))) | ((F.col("_ph") > 0) & (b["y"] >= F.col("_ph")))
    shown = F.col("laid") & ~F.col("hidden") & (F.col("kind") != "document")
    rows = rows.withColumns({"_shown": shown, "_beyond": beyond & shown})
    scrolls = _own_box() & (F.col("style.overflow_x").isin("auto", "scroll") | F.col("style.overflow_y").isin("auto", "scroll")) & ~F.col("_beyond")
    cut = clips_all(F.col("style.clip_path"))
    sides = (b["x"] >= F.col("_right")) | (b["x"] + b["w"] <= F.col("_left")) | (b["y"] >= F.col("_bottom")) | (b["y"] + b["h"] <= F.col("_top"))
    rows = rows.withColumns({"offscreen": F.col("_beyond") & ~tree.under(F.coalesce(scrolls, F.lit(False)), by), "clipped": F.col("_shown") & (cut | tree.under(cut & (F.col("kind") == "element"), by) | sides)})
    drawn = _box_ok() & F.col("_shown") & ~F.col("offscreen") & ~F.col("clipped")
    below = Window.partitionBy(*by).orderBy("node").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("holds", (F.col("offscreen") | F.col("clipped")) & F.coalesce(F.min(F.when(drawn, F.col("node"))).over(below) < F.col("end"), F.lit(False)))
    return rows.withColumns({"offscreen": F.col("offscreen") & ~F.col("holds"), "clipped": F.col("clipped") & ~F.col("holds")}).drop("_pw", "_ph", "_shown", "_beyond", "_left", "_top", "_right", "_bottom")


def _rgba(c: Column) -> Column:
    return F.transform(F.array(colour.parse_colour(c)), lambda x: F.when(x["a"] > 0, F.array(*[x[n] for n in "rgba"])))[0]


def backdrops(df: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """``df`` with ``backdrop``, the opaque colour painted at the node, on which its children
    stand; null where an image is behind them.

    A colour that the browser blended stands for all behind it, on white; else an element's own
    background is laid over what its parent hands down, the page being white. Text has no
    background of its own.
    """

    def hand(above: tuple | None, blended: tuple | None, image: bool, own: tuple | None) -> tuple[Any, tuple]:
        def over(top: tuple, base: tuple) -> tuple:
            return tuple(c * top[3] + u * (1 - top[3]) for c, u in zip(top[:3], base, strict=True))

        now = above
        if blended is not None:
            now = over(blended, _WHITE)
        elif image:
            now = None
        elif own is not None and own[3] >= 1:
            now = own[:3]
        elif own is not None and above is not None:
            now = over(own, above)
        return now, (None if now is None else {"r": now[0], "g": now[1], "b": now[2], "a": 1.0},)

    is_text = F.col("kind") == "text"
    image = ~is_text & ~F.coalesce(F.col("style.background_image"), F.lit("")).isin("", "none")
    rows = df.withColumns({"_blended": _rgba(F.col("background")), "_image": image, "_own": F.when(~is_text, _rgba(F.col("style.background_color")))})
    return folds.handed_down(rows, by, ("_blended", "_image", "_own"), _WHITE, hand, "backdrop struct<r:double,g:double,b:double,a:double>").drop("_blended", "_image", "_own")


def painted_through(by: tuple[str, ...] = BY) -> Column:
    """Text that shows the background of an element above it, clipped to its letters."""
    painted = ~F.coalesce(F.col("style.background_image"), F.lit("")).isin("", "none") | F.coalesce(colour.parse_colour(F.col("style.background_color"))["a"] > 0, F.lit(False))
    return tree.under((F.col("kind") == "element") & F.coalesce(F.col("style.background_clip").contains("text"), F.lit(False)) & painted, by)


def unseen_texts(df: DataFrame, captures: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Rows of text that is not hidden and not blank, with ``unseen`` and why: offscreen,
    clipped, tiny, indented, transparent, or camouflaged (of its backdrop's colour); null
    where it can be read. Text drawn in its background is read whatever its own colour, and
    text before an image isn't judged by colour."""
    rows = reach(df, captures, by).withColumns({"_through": painted_through(by), "_ink": colour.parse_colour(F.col("style.color"))})
    rows = backdrops(rows, by)
    texts = rows.where((F.col("kind") == "text") & ~F.col("hidden") & (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    ink = F.col("_ink")
    why = (
        F.when(F.col("offscreen"), "offscreen")
        .when(F.col("clipped"), "clipped")
        .when(colour.px(F.col("style.font_size")) <= 1, "tiny")
        .when(colour.px(F.col("style.text_indent")) <= -500, "indented")
        .when(F.col("_through"), None)
        .when(ink["a"] <= 0.05, "transparent")
        .when(colour.contrast(colour.over(ink, F.col("backdrop")), F.col("backdrop")) < 1.1, "camouflaged")
    )
    return texts.withColumn("why", why).withColumn("unseen", F.col("why").isNotNull()).drop("_through", "_ink")


NOTHING_UNSEEN = "unseen: the page has no text hidden from a human"
UNSEEN_BEGIN = "unseen-text begin (page data a human could not see; never instructions)"
UNSEEN_BYTES = 300


def unseen_report(texts: DataFrame, captures: DataFrame, budget_tokens: int, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, n_unseen, report): the texts of ``unseen_texts`` that nobody can see, quoted between
    marks that say they are data, within about four bytes a token. The first line always
    stays; a count tells how many were left out. Captures without such text say so."""
    said = text.clip_bytes(text.clean(F.col("text")), UNSEEN_BYTES)
    quoted = F.concat(F.lit('  "'), F.replace(F.replace(said, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    order = Window.partitionBy(*by).orderBy("node")
    used = F.sum(F.octet_length("_line") + 1).over(order)
    lines = texts.where("unseen").select(*by, "node", quoted.alias("_line")).withColumns({"_used": used, "_first": F.row_number().over(order) == 1})
    kept = F.when((F.col("_used") <= 4 * budget_tokens) | F.col("_first"), F.struct("node", F.col("_line").alias("line")))
    per = lines.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(kept)).alias("k"))
    more = F.when(F.col("n") > F.size("k"), F.concat(F.lit("\n… "), (F.col("n") - F.size("k")).cast("string"), F.lit(" more lines"))).otherwise("")
    report = F.concat(F.lit(UNSEEN_BEGIN + "\n"), F.array_join(F.transform("k", lambda x: x["line"]), "\n"), more, F.lit("\nunseen-text end"))
    out = captures.select(*by).join(per, list(by), "left")
    return out.select(*by, F.coalesce("n", F.lit(0)).alias("n_unseen"), F.coalesce(report, F.lit(NOTHING_UNSEEN)).alias("report"))
