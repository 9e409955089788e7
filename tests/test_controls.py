from __future__ import annotations

from folioscan.operators import controls, facts
from folioscan.sources.markup import nodes


def test_resolve_by_name(spark):
    rows = [(1, 2, 3, "Save", False), (1, 4, 5, "save", False), (1, 6, 9, "Open", False), (1, 7, 8, "Open", False), (1, 10, 11, "Gone", True), (1, 12, 13, "Save as copy", False)]
    named = spark.createDataFrame(rows, "page_id long, node int, end int, name string, hidden boolean")
    asked = spark.createDataFrame([(1, 1, "Save"), (2, 1, "SAVE"), (3, 1, "Open"), (4, 1, "gone"), (5, 1, "as copy"), (6, 1, "nothing"), (7, 2, "Save")], "query_id long, page_id long, text string")
    got = {r.query_id: (r.outcome, r.node, r.matches) for r in controls.resolve(asked, named).collect()}
    assert got == {1: ("found", 2, 1), 2: ("ambiguous", None, 2), 3: ("found", 7, 1), 4: ("found", 10, 1), 5: ("near", None, 1), 6: ("not found", None, 0), 7: ("not found", None, 0)}


def test_blocked_and_errors(spark):
    html = '<form><input aria-errormessage="e"><p id="e"> <b>Too short</b> again</p><p id="e">second</p><button disabled>x</button><button hidden>y</button><button>z</button></form>'
    f = facts.facts(nodes(spark.createDataFrame([(1, html)], "page_id long, html string")))
    assert [r.error for r in controls.error_texts(f, facts.readable(f)).collect()] == ["Too short"]
    c = f.where("role = 'button'")
    last = c.agg({"node": "max"}).first()[0]
    covers = spark.createDataFrame([(1, last, 99, False)], "page_id long, node int, coverer int, in_dialog boolean")
    got = [(r.blocked_by, r.may_clear) for r in controls.blocked(c, covers).orderBy("node").collect()]
    assert got == [("disabled", True), ("hidden", False), ("covered-by", True)]


def test_struck(spark):
    style = "struct<text_decoration:string,position:string,float:string,display:string>"
    plain, line, off = ("none", "static", "none", "inline"), ("line-through", "static", "none", "block"), ("none", "absolute", "none", "block")
    rows = [(1, 0, [], plain), (1, 1, [0], line), (1, 2, [0, 1], plain), (1, 3, [0, 1], off), (1, 4, [0, 1, 3], plain), (2, 0, [], plain)]
    df = spark.createDataFrame(rows, f"capture_id long, node int, path array<int>, style {style}")
    assert [r.struck for r in controls.struck(df).orderBy("capture_id", "node").collect()] == [False, True, True, False, False, False]
