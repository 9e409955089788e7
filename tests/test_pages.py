from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import changes, facts, tree, views
from folioscan.sources.markup import nodes, tree_of

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a><li><a href="/b c">B</a></ul></nav><main><h1>Head <i>line</i></h1><p>One <b>two</b>, <a href="/x">three  four</a>.<p>Five<br>six
<ul><li>item<ul><li>inner</ul></ul><pre>a
  b</pre><blockquote>said</blockquote><img alt="pic" src="/p.png"><p hidden>never</p><button>Go</button></main>
<form><label for="f">Name</label><input id="f" required><input type="checkbox" aria-label="Agree" checked><select disabled><option>o</select></form>
<table><tr><th>k<th>v<tr><td>1<td>a|b</table><footer>end <a href="mailto:x">mail</a></footer></body></html>"""


def frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


def test_tree_intervals_hold():
    rows = tree_of(PAGE)
    for n, parent, end, depth, path, *_ in rows:
        assert end > n and len(path) == depth and (parent is None or (path[-1] == parent and rows[parent][2] >= end and parent < n))
    assert tree_of(None) == [(0, None, 1, 0, [], "document", "", "", [], 0, 0)]


def test_markdown_golden(spark):
    f = facts.facts(nodes(frame(spark, PAGE, "", None)))
    got = {r.page_id: r for r in views.markdown(f).collect()}
    assert got[0].markdown.split("\n\n") == ["# Head line", "One **two**, [three four](/x).", "Five", "six", "- item", "  - inner", "```\na\n  b\n```", "> said", "![pic](/p.png)"]
    assert got[1].markdown == got[2].markdown == views.NOTHING


def test_ancestors_and_counts_equal_brute_force(spark):
    n = nodes(frame(spark, PAGE)).withColumn("under_ul", tree.under(F.col("tag") == "ul"))
    counted = tree.subtree_count(n, F.col("tag") == "li", "items").collect()
    by = {r.node: r for r in counted}
    for r in counted:
        assert r.under_ul == any(by[p].tag == "ul" for p in r.path)
        assert r["items"] == sum(x.tag == "li" and r.node < x.node < r.end for x in counted)


def test_inventory_names_states(spark):
    f = facts.facts(nodes(frame(spark, PAGE)))
    got = [(r.role, r.name, r.tags) for r in views.inventory(f).orderBy("pos").collect()]
    assert got == [("link", "A", []), ("link", "B", []), ("link", "three four", []), ("button", "Go", []), ("textbox", "Name", ["required"]), ("checkbox", "Agree", ["checked"]), ("combobox", "", ["disabled"]), ("option", "o", []), ("link", "mail", [])]
    assert [r.ref for r in views.refs(views.inventory(f)).where("role = 'link'").orderBy("pos").collect()] == ["l1", "l2", "l3", "l4"]
    audit = {(r.role, r.verdict) for r in facts.contradictions(f).collect()}
    assert audit == {("combobox", "unlabelled")}


def test_outline_holds_the_whole_page(spark):
    more = """<header><p>top <a href="/h">home</a></header><main><h2>In</h2><section aria-label="S"><p>deep</p><a href="/i" aria-label="icon"></a>
<nav><button>never</button></nav></section><button>Go <b>on</b></button></main><aside>side<div role="search"><input type="search" placeholder="find"></div></aside><p hidden><button>no</button></p><div role="button">tap</div>tail"""
    f = facts.facts(nodes(frame(spark, PAGE, more, "", None)))
    got: dict[int, list] = {}
    for r in views.outline(f).orderBy("page_id", "pos", "line").collect():
        got.setdefault(r.page_id, []).append("  " * r.indent + r.line)
    body = ["# Head line", "One **two**, [three four](/x).", "Five", "six", "- item", "  - inner", "```\na\n  b\n```", "> said", "![pic](/p.png)"]
    want = ["navigation (2 links)", "main (1 links)", *("  " + x for x in (*body, 'button "Go"')), "form (0 links)", *("  " + x for x in ("Name", 'textbox "Name" required', 'checkbox "Agree" checked', "combobox disabled", 'option "o"')), "k", "v", "1", "a|b", "contentinfo (1 links)"]
    assert got[0] == want
    assert got[1] == ["banner (1 links)", "  top [home](/h)", "main (1 links)", "  ## In", "  region (1 links)", "    deep", '    link "icon"', "    navigation (0 links)", '  button "Go on"', "complementary (0 links)", "  side", "  search (0 links)", '    searchbox "find"', 'button "tap"', "tap", "tail"]
    assert set(got) == {0, 1}
    assert [r.line for r in views.markdown_lines(f).where("page_id = 0").orderBy("pos").collect()] == body


def test_tables_and_search(spark):
    f = facts.facts(nodes(frame(spark, PAGE)))
    t = views.tables_tsv(f)
    assert [r.tsv for r in t.orderBy("row").collect()] == ["k\tv", "1\ta|b"]
    assert views.markdown_tables(t).first().markdown == "| k | v |\n| --- | --- |\n| 1 | a\\|b |"
    terms = spark.createDataFrame([("FOUR",), ("never",), ("item",)], "term string")
    assert {r.term: r.hits for r in views.search(f, terms).collect()} == {"FOUR": 1, "item": 1}


def lines(rows):
    return [("p", k, key, "", "text", body, tags, f"text {body}") for k, (key, body, tags) in enumerate(rows)]


def test_diff_of_views(spark):
    schema = "pair string, pos int, key long, ref string, label string, body string, tags array<string>, text string"
    old = spark.createDataFrame(lines([(1, "a", []), (2, "b", ["x"]), (0, "u", []), (0, "u", []), (3, "gone", []), (1, "dup", [])]), schema)
    new = spark.createDataFrame(lines([(2, "b", ["y"]), (1, "A", []), (0, "u", []), (0, "v", []), (4, "new", [])]), schema)
    got = [(r.op, r.text) for r in changes.fit_delta(changes.diff(old, new), 0).orderBy("rank").collect()]
    assert got == [("-", "text u"), ("-", "text gone"), ("+", "text v"), ("+", "text new"), ("~", "text b +y -x"), ("~", "text A")]
    assert changes.diff(old, old).count() == 0
    fit = changes.fit_delta(changes.diff(old, new), 4).orderBy("rank").collect()
    assert [r.kept for r in fit] == [True, False, False, False, False, False] and fit[0].left_out == 5
