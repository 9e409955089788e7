"""Facts are asked of a page in few windows, none of which takes the square of the page."""

from __future__ import annotations

import re

from folioscan.operators import facts, tree
from folioscan.sources.markup import nodes

PAGE = """<fieldset disabled><legend><input id=a></legend><legend><input id=b></legend><fieldset disabled><legend><input id=c></legend></fieldset></fieldset>
<section><header id=d>x</header></section><header id=e>y</header><div id=f contenteditable><p>z</div><div id=g contenteditable><p><a href=/x>z</a></div><label id=h onclick=x()><input></label><p id=i style='opacity: .001'>gone</p><p id=j style='opacity:x'>here</p>"""


def test_windows_end_at_the_row_and_projections_compile(spark):
    f = facts.facts(nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string")))
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "1, unboundedfollowing" not in plan and "1, unboundedfollowing" not in facts.names(f)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"[-+] Window \[", plan)) <= 4 and len(re.findall(r"[-+] Sort \[", plan)) <= 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = spark._jvm.PythonSQLUtils.explainString(facts.facts(f.select("page_id", "node", "parent", "end", "depth", "path", "kind", "tag", "text", "attrs", "block", "lists"))._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)) < 8000  # longer methods are never compiled to machine code


def test_facts_of_first_legends_sections_hosts_and_faint_texts(spark):
    f = facts.facts(nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string")))
    got = {r.id: r for r in f.where("attrs['id'] is not null").selectExpr("attrs['id'] as id", "role", "disabled", "hidden", "clickable").collect()}
    assert [got[c].disabled for c in "abc"] == [False, True, True]
    assert [got[c].role for c in "defg"] == ["", "banner", "textbox", ""]
    assert not got["h"].clickable and got["i"].hidden and not got["j"].hidden


def test_holds_equals_brute_force(spark):
    df = spark.createDataFrame([(1, 0, 7, "a"), (1, 1, 3, "b"), (1, 2, 3, "x"), (1, 3, 6, "c"), (1, 4, 6, "d"), (1, 5, 6, "e"), (1, 6, 7, "x"), (2, 0, 1, "a")], "page_id long, node int, end int, tag string")
    got = {(r.page_id, r.node) for r in df.withColumn("h", tree.holds(df.tag == "x")).where("h").collect()}
    assert got == {(1, 0), (1, 1)}
