"""Captures, folds over the tree, clipping, backdrops and covers, by brute force."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import folds, geometry, visibility
from folioscan.sources import captures


def random_tree(rng, n):
    """Parents of n nodes in document order."""
    open_, parents = [0], [None]
    for k in range(1, n):
        del open_[rng.randint(1, len(open_)) :]
        parents.append(open_[-1])
        open_.append(k)
    return parents


def ancestors(parents, k):
    while parents[k] is not None:
        k = parents[k]
        yield k


def test_intervals_of_random_trees(spark):
    rng = random.Random(1)
    trees = {c: random_tree(rng, rng.randint(1, 120)) for c in range(12)}
    df = spark.createDataFrame([(c, k, p) for c, t in trees.items() for k, p in enumerate(t)], "capture_id long, node int, parent int")
    got = {(r.capture_id, r.node): r.end for r in folds.intervals(df).collect()}
    for c, t in trees.items():
        for k in range(len(t)):
            assert got[c, k] == 1 + max([k] + [j for j in range(len(t)) if k in ancestors(t, j)])


def test_values_handed_down(spark):
    rng = random.Random(2)
    t = random_tree(rng, 200)
    df = spark.createDataFrame([(0, k, p) for k, p in enumerate(t)], "capture_id long, node int, parent int")
    df = df.join(folds.intervals(df), ["capture_id", "node"])
    down = folds.handed_down(df, ("capture_id",), ("node",), (), lambda above, k: ((*above, k), (list(above),)), "up array<int>")
    assert {r.node: r.up for r in down.collect()} == {k: sorted(ancestors(t, k)) for k in range(200)}
    assert folds.scan(df.limit(0), ("capture_id",), ("node",), ("node",), int, lambda s, k: (s, (s,)), "x int").count() == 0


def big_capture(n, strings=200):
    """A capture of n nodes, each with attributes and a box, some sparse marks."""
    names = ["#document", "DIV", "#text", "id", "class"] + [f"s{k}" for k in range(strings)]
    rng = random.Random(n)
    nodes = {"parentIndex": [-1] + [rng.randint(max(0, k - 20), k - 1) for k in range(1, n)], "nodeType": [9] + [1 if k % 3 else 3 for k in range(1, n)], "nodeName": [0] + [1 if k % 3 else 2 for k in range(1, n)], "nodeValue": [-1 if k % 3 else 5 + k % strings for k in range(n)], "backendNodeId": list(range(n)), "attributes": [[3, 5 + k % strings, 4, 6, 3, 7] for k in range(n)], "isClickable": {"index": list(range(0, n, 7))}, "inputValue": {"index": list(range(0, n, 11)), "value": [5] * len(range(0, n, 11))}, "textValue": {"index": [11, 11], "value": [6, 7]}}
    layout = {"nodeIndex": list(range(1, n)) + [1], "bounds": [[k, 1, 2, 3] for k in range(1, n)] + [[9, 9, 9, 9]], "paintOrders": list(range(n)), "text": [-1] * n, "styles": [[5, 6]] * n, "blendedBackgroundColors": [-1] * n, "scrollRects": [[]] * n}
    return json.dumps({"documents": [{"nodes": nodes, "layout": layout}], "strings": names})


def test_a_capture_of_many_nodes(spark):
    """100,000 nodes in one capture beside small ones; before, 8,000 ran out of memory."""
    raw = spark.createDataFrame([(1, big_capture(100_000)), (2, big_capture(12)), (3, '{"documents":[]}'), (4, '{"documents":[{"nodes":{}}]}'), (5, None), (6, "{")], "capture_id long, capture string")
    out, rejected = captures.decode(raw)
    got = out.groupBy("capture_id").agg(F.count("*").alias("n"), F.count_if("clickable").alias("c"), F.count_if(F.col("value") != "").alias("v"), F.sum("box.x").alias("x"), F.count_if("laid").alias("laid"), F.sum(F.size("attrs")).alias("attrs")).orderBy("capture_id").collect()
    want = lambda n: (n, len(range(0, n, 7)), len(range(0, n, 11)), sum(range(2, n)) + 9.0, n - 1, 2 * n)
    assert [tuple(r)[1:] for r in got] == [want(100_000), want(12)]
    assert {r.capture_id: r.reason for r in rejected.collect()} == {3: "no documents", 4: "no nodes", 5: "no documents", 6: "no documents"}
    small = {r.node: r for r in out.where("capture_id = 2").collect()}
    assert small[11].value == "s2" and small[0].value == "s0" and small[4].attrs == {"id": "s4", "class": "s1"} and small[3].text == "s3"
    assert (small[4].style.display, small[4].style.visibility, small[4].style.opacity) == ("s0", "s1", "") and small[0].box.w == 0 and small[1].box.h == 9


BOX = "struct<x:double,y:double,w:double,h:double>"


def shown_boxes(rng, n):
    t = random_tree(rng, n)
    return [(k, t[k], rng.randint(0, 300) * 1.0, rng.randint(0, 300) * 1.0, rng.choice([2.0, 3.5, 40.0, 300.0, 900.0]), rng.choice([3.0, 30.0, 300.0, 900.0]), rng.randint(0, 60), rng.random() < 0.4) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_covers_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = shown_boxes(rng, 80)
    t = [r[1] for r in rows]
    data = [(1, k, p, list(ancestors(t, k))[::-1], (x, y, w, h), paint, paints) for k, p, x, y, w, h, paint, paints in rows]
    df = spark.createDataFrame(data, f"capture_id long, node int, parent int, path array<int>, box {BOX}, paint int, paints boolean")
    df = df.join(folds.intervals(df.select("capture_id", "node", "parent")), ["capture_id", "node"])

    def covered(k):
        _, _, x, y, w, h, paint, _ = rows[k]
        points = [(x + w / 2, y + h / 2)]
        if w >= 4 and h >= 4:
            points += [(x + a, y + b) for a in (1, w - 1) for b in (1, h - 1)]
        over = [r for r in rows if r[7] and r[6] > paint and r[0] != k and k not in ancestors(t, r[0]) and r[0] not in ancestors(t, k)]
        holds = lambda r, q: r[2] <= q[0] < r[2] + r[4] and r[3] <= q[1] < r[3] + r[5]
        if not all(any(holds(r, q) for r in over) for q in points):
            return None
        return max((r for r in over if holds(r, points[0])), key=lambda r: (r[6], -r[0]))[0]

    want = {k: c for k in range(80) if (c := covered(k)) is not None}
    assert {r.node: r.coverer for r in geometry.occluded(df).collect()} == want
    assert want


def test_lines_take_the_lesser_height(spark):
    rows = [(1, 0, 1, (0.0, 0.0, 10.0, 100.0)), (1, 0, 2, (50.0, 40.0, 10.0, 10.0)), (1, 0, 3, (20.0, 4.0, 10.0, 10.0)), (1, 0, 4, (5.0, 0.2, 10.0, 0.0))]
    got = geometry.reading_order(spark.createDataFrame(rows, f"capture_id long, parent int, node int, box {BOX}")).orderBy("pos").collect()
    assert [(r.node, r.row) for r in got] == [(1, 0), (4, 0), (3, 0), (2, 1)]


STYLE = "struct<overflow_x:string,overflow_y:string,position:string,clip_path:string,color:string,background_color:string,background_image:string,background_clip:string,font_size:string,text_indent:string>"


def drawn(spark, rows):
    """rows: (node, parent, kind, box, style overrides)."""
    base = {"overflow_x": "visible", "overflow_y": "visible", "position": "static", "clip_path": "none", "color": "rgb(0,0,0)", "background_color": "", "background_image": "none", "background_clip": "border-box", "font_size": "16px", "text_indent": "0px"}
    data = [(1, k, p, kind, "div", "words", False, True, box, tuple((base | more).values()), "") for k, p, kind, box, more in rows]
    df = spark.createDataFrame(data, f"capture_id long, node int, parent int, kind string, tag string, text string, hidden boolean, laid boolean, box {BOX}, style {STYLE}, background string")
    page = spark.createDataFrame([(1, 1000.0, 1000.0, 800.0, 600.0)], "capture_id long, content_w double, content_h double, viewport_w double, viewport_h double")
    return df.join(folds.intervals(df.select("capture_id", "node", "parent")), ["capture_id", "node"]), page


def test_fixed_boxes_escape_clipping_and_wrappers_hold(spark):
    inside, away = (0.0, 0.0, 50.0, 50.0), (2000.0, 0.0, 50.0, 50.0)
    df, page = drawn(spark, [
        (0, None, "element", (0.0, 0.0, 100.0, 100.0), {"overflow_x": "hidden"}),
        (1, 0, "element", (200.0, 0.0, 50.0, 50.0), {}),
        (2, 1, "element", (300.0, 0.0, 50.0, 50.0), {"position": "fixed"}),
        (3, 0, "element", (0.0, 500.0, 50.0, 50.0), {}),
        (4, None, "element", away, {"overflow_y": "scroll"}),
        (5, 4, "element", away, {}),
        (6, None, "element", inside, {"overflow_y": "auto"}),
        (7, 6, "element", away, {}),
        (8, None, "element", inside, {"clip_path": "inset(100%)"}),
        (9, 8, "element", inside, {"position": "fixed"}),
    ])
    got = {r.node: (r.offscreen, r.clipped, r.holds) for r in visibility.reach(df, page).collect()}
    no, clipped, off = (False, False, False), (False, True, False), (True, False, False)
    assert got == {0: no, 1: (False, False, True), 2: no, 3: no, 4: off, 5: off, 6: no, 7: no, 8: clipped, 9: clipped}


def test_layers_add_up_to_a_backdrop(spark):
    box = (0.0, 0.0, 50.0, 50.0)
    df, page = drawn(spark, [
        (0, None, "element", box, {"background_color": "rgb(0, 0, 0)"}),
        (1, 0, "element", box, {"background_color": "rgba(255, 255, 255, 0.5)"}),
        (2, 1, "text", box, {"color": "rgb(128, 128, 128)", "background_color": "rgb(1, 1, 1)"}),
        (3, 1, "element", box, {"background_image": "url(a)"}),
        (4, 3, "text", box, {"color": "rgb(128, 128, 128)"}),
        (5, 3, "element", box, {"background_color": "rgb(9, 9, 9)"}),
        (6, 5, "text", box, {"color": "#090909"}),
        (7, 1, "element", box, {"background_clip": "text", "background_color": "red"}),
        (8, 7, "text", box, {"color": "rgba(0, 0, 0, 0)"}),
        (9, 0, "text", box, {"color": "rgba(200, 0, 0, 0.04)"}),
    ])
    got = {r.node: (r.why, r.backdrop and round(r.backdrop.r, 1)) for r in visibility.unseen_texts(df, page).collect()}
    assert got == {2: ("camouflaged", 127.5), 4: (None, None), 6: ("camouflaged", 9.0), 8: (None, 255.0), 9: ("transparent", 0.0)}
