"""Outlines by hand: entries, wrappers, nested lists, layout tables; budgets and cuts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import entries, facts
from folioscan.sources.markup import nodes

PAGE = """<body><header><h1>Shop</h1></header><nav><a href=/a>A</a><a href=/b>B</a></nav><main><h2>Things</h2>
<div class=grid><div class=card><a href=/1>One</a><p>first</p></div><div class=card><a href=/2>Two</a><p>second</p></div><div class=card><a href=/3>Three</a><p>third</p></div><div class=card><a href=/4>Four</a><p>fourth</p></div></div>
<ul><li>plain<ul><li><a href=/x>x</a></li><li><a href=/y>y</a></li></ul></li><li><a href=/z>z</a> tail</li></ul>
<table><tr><td><table><tr><td><button>in</button></td><td>cell</td></tr><tr><td><button>in2</button></td><td>cell2</td></tr></table></td></tr></table>
<p>words <b>and</b> <a href=/l>a link</a> in it</p><div><span><button>Go</button></span></div></main><footer><a href=/f>F</a></footer></body>"""

OUTLINE = """header
  heading "Shop"
nav r1 collapsed 2 links
main
  heading "Things"
  list r2 x4
    item link a1 "One" text "first"
    item link a2 "Two" text "second"
    item link a3 "Three" text "third"
    item link a4 "Four" text "fourth"
  list
    item
      text "plain"
      list x2
        item link a5 "x"
        item link a6 "y"
    item link a7 "z" text "tail"
  table r3 x2
    row button b1 "in" text "cell"
    row button b2 "in2" text "cell2"
  text "words and a link in it"
  button b3 "Go"
footer r4 collapsed 1 links"""


def outline(spark, *pages):
    f = facts.facts(nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")))
    return entries.outline_lines(entries.arrange(entries.items(f)))


def test_outline_of_a_page(spark):
    got = outline(spark, PAGE, "", None, "<p>only words").orderBy("page_id", "pos").collect()
    assert "\n".join(r.line for r in got if r.page_id == 0) == OUTLINE
    assert [r.line for r in got if r.page_id > 0] == ['text "only words"']
    kept_order = {r.line.strip(): r["class"] for r in got if r.page_id == 0}
    assert kept_order["nav r1 collapsed 2 links"] < kept_order["main"] < kept_order['item link a1 "One" text "first"'] < kept_order["footer r4 collapsed 1 links"] < kept_order['item link a4 "Four" text "fourth"']


def tree(spark, rows):
    """rows: (depth, sort, head, kind) in document order under one box."""
    out, up = [(1, 0, None, "box", "", "", "")], {0: 0}
    for k, (depth, sort, head, kind) in enumerate(rows, 1):
        out.append((1, k, up[depth - 1], sort, head, kind, ""))
        up[depth] = k
    got = entries.arrange(spark.createDataFrame(out, "page_id long, node int, parent int, sort string, head string, kind string, name string"))
    return [(r.indent, r.head, r.kind, r.run, r.repeat) for r in got.orderBy("pos").collect()]


LINK, TEXT = ("leaf", "link", "a"), ("text", "text", "")


def test_a_run_in_a_larger_section_becomes_a_list_of_its_own(spark):
    cards = [x for _ in range(3) for x in ((1, "box", "", ""), (2, *LINK), (2, *TEXT))]
    assert tree(spark, cards) == [(0, "list", "r", -1, 3)] + [x for k in range(3) for x in ((1, "item", "", k, 0), (2, "link", "a", -1, 0), (2, "text", "", -1, 0))]
    assert tree(spark, [(1, *TEXT), *cards])[:3] == [(0, "text", "", -1, 0), (0, "list", "r", -1, 3), (1, "item", "", 0, 0)]
    assert tree(spark, cards[:6]) == [(0, "link", "a", -1, 0), (0, "text", "", -1, 0)] * 2  # two are no run
    assert tree(spark, [(1, *TEXT)] * 5) == [(0, "text", "", -1, 0)] * 5  # prose is no list


def test_wrappers_dissolve_and_single_things_take_their_place(spark):
    wrapped = [x for _ in range(3) for x in ((1, "box", "", ""), (2, "box", "", ""), (3, *LINK))]
    assert tree(spark, wrapped) == [(0, "list", "", -1, 3)] + [(1, "link", "a", k, 0) for k in range(3)]
    layout = [(1, "box", "table", "r"), (2, "box", "row", ""), (3, "box", "table", "r"), (4, *TEXT)]
    assert tree(spark, layout) == [(0, "table", "r", -1, 0), (1, "text", "", -1, 0)]
    two = [(1, "box", "list", ""), (2, "box", "item", ""), (3, *TEXT), (2, "box", "item", ""), (3, *TEXT)]
    assert tree(spark, two)[0] == (0, "list", "", -1, 2)  # under a list two are a run
    first = [(1, *LINK)] * 3 + [(1, *TEXT)] + [(1, *LINK)] * 3
    assert [r[3] for r in tree(spark, first)] == [-1, 0, 1, 2, -1, -1, -1, -1]  # the first of equals


def random_lines(rng, n):
    """Lines of a random outline: (pos, up, indent, node, class, rank, ref, line)."""
    open_, out = [], []
    for k in range(n):
        del open_[rng.randint(0, len(open_)) :]
        indent = len(open_)
        out.append((k, open_[-1] if open_ else -1, indent, 100 + k, rng.randint(2, 7), rng.randint(0, 1), f"r{k + 1}" if rng.random() < 0.3 else "", "  " * indent + "w" * rng.randint(1, 60)))
        open_.append(k)
    return out


@pytest.mark.parametrize("budget", [0, 6, 20, 60, 200, 10_000])
def test_budgets_hold_and_every_gap_is_marked(spark, budget):
    rng = random.Random(budget)
    pages = {p: random_lines(rng, rng.randint(1, 60)) for p in range(12)}
    df = spark.createDataFrame([(p, *r) for p, rows in pages.items() for r in rows], "page_id long, pos int, up int, indent int, node int, class int, rank int, ref string, line string")
    got = {p: [] for p in pages}
    for r in entries.fit(df, budget).orderBy("page_id", "pos").collect():
        got[r.page_id].append(r)
    for p, rows in pages.items():
        out, lines = got[p], {r[0]: r for r in rows}
        if not out:
            assert budget <= 6
            continue
        assert sum(len(r.line) + 1 for r in out) <= 4 * budget
        kept = {r.pos for r in out if r.what != "marker"}
        gaps = [k for k in lines if k not in kept and (k == 0 or k - 1 in kept)]
        assert [r.pos for r in out if r.what == "marker"] == gaps
        for r in out:
            if r.what == "marker":
                after = next((k for k in range(r.pos, len(rows)) if k in kept), len(rows))
                assert f"… {after - r.pos} more line" in r.line and r.line.endswith(f" {r.ref}") and r.ref
                up = lines[r.pos][1]
                own = lines[up][6] if up in kept else ""
                assert r.ref == (own or lines[r.pos][6] or r.ref) and (r.opens is not None) == (not own and not lines[r.pos][6])
            elif r.what == "line":
                assert r.line == lines[r.pos][7] and (lines[r.pos][1] < 0 or lines[r.pos][1] in kept)
        fresh = [r.ref for r in out if r.opens is not None]
        assert len(set(fresh)) == len(fresh) and not set(fresh) & {r[6] for r in rows if r[6]} or any(r[6] for r in rows)
        if budget == 10_000:
            assert kept == set(lines)


def test_cuts_fall_between_words_outside_links_and_emphasis(spark):
    lines = ["plain words that go on and on for a while", "a text with [a link that is long](http://x.org/y) behind it all", "some words then **bold words that go on** end of it", "x" * 90, "one `code with blanks in it` and so on", "ends! here, now [brackets] are plain * star"]
    rooms = range(20, 60)
    df = spark.createDataFrame([(k, r, t) for k, t in enumerate(lines) for r in rooms], "k int, room int, line string")
    for r in df.withColumn("cut", entries.cut_line(F.col("line"), F.col("room"))).collect():
        if r.cut is None:
            continue
        assert r.line.startswith(r.cut) and 24 <= len(r.cut) <= r.room
        if r.k == 3:
            assert len(r.cut) == r.room
            continue
        rest = r.line[len(r.cut) :]
        assert rest == "" or rest[0] == " "
        assert r.cut.count("[") == r.cut.count("]") and r.cut.count("(") == r.cut.count(")") and r.cut.count("**") % 2 == 0 and r.cut.count("`") % 2 == 0
