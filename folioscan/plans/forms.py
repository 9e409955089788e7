"""Registered queries on forms, tables and maps: each page of the table yields one form page of
its own number and address, so states, names and boxes vary from page to page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscan.functions import colour
from folioscan.operators import controls, facts, geometry, views
from folioscan.sources.markup import nodes
from folioscan.sources.stored import stored

FORM = (
    "<body><form id=form><fieldset id=fs{off}><legend id=l1><input id=a></legend><legend><input id=b></legend><input id=c type=checkbox{on}>"
    "<select id=d multiple><optgroup{off} label=g><option id=e selected>E{k}</option></optgroup></select></fieldset>"
    "<label for=f>Mail of {id}</label><input id=f type=email required aria-errormessage=err><p id=err>Bad <b>mail</b></p>"
    "<label>Age {k} <input id=g type=number placeholder=years></label><input id=h type=submit value='Send {id}'>"
    "<details{open}><summary id=i>More</summary></details><button id=j aria-pressed={pressed} aria-label='Star {k}'>x</button>"
    "<div id=k onclick=x()>block</div><span id=l tabindex=0>y</span><span id=l2 tabindex=-1>y</span><label id=m for=f onclick=x()>z</label><label id=n onclick=x()>plain</label>"
    "<a id=o href='mailto:me@host{id}.org'>write</a><a id=p href=/x.zip download>get {id}</a><progress id=q value={k} max=4></progress><meter id=r min=10 max=20 value=1{k}></meter>"
    "<progress id=q2></progress><progress id=q3 value=3 max=0 min=2 aria-valuetext='{k} of \"4\"'></progress><div id=q4 role=progressbar aria-valuenow={id} value=7 aria-valuemax=200></div><div id=q5 role=meter value=5></div><div id=q6 role=meter aria-valuenow=2.5 aria-valuemin=9 aria-valuemax=9></div>"
    "<a id=o2 href=' TEL:+{id}-{pad}'>call</a><p id=f1 style='opacity: 0.05'>faint</p><p id=f2 style='opacity:.005'>gone</p><input id=h2 type=submit><input id=h3 type=image alt='Go {k}' title=t><input id=h4 alt=no title='T {id}' placeholder=p><div id=d1 role=dialog title=no><p>x<h3>Head {id}</h3></div><button id=j3 aria-labelledby='j l1x j2'>no</button><ul><li id=z2 role=treeitem>leaf</li></ul>"
    "<div id=s contenteditable>free <b>text</b></div><div id=t contenteditable><h2 id=t2>x</h2></div><img id=u src=x alt='Pic {id}' usemap=#m><img id=v src=x alt=''>"
    "<map name=m><area id=w href=/y shape={shape} coords='{k},2,30,40'></map><section id=x aria-labelledby='l1 zz j2'></section><span id=j2>by {id}</span>"
    "<table id=tab><thead id=th><tr><th id=x1 scope=row>R</th><th id=x2>C | {k}</th></tr></thead><tr><td id=x3>v{id}</td><td></td></tr></table><output id=y>0</output><ul><li id=z>one<ul><li>two {k}</ul></ul></form></body>"
)


def _forms(spark, sf_dir):
    """(page_id, html): FORM with the page's number; k is its remainder by 4."""
    k = F.col("page_id") % 4
    words = {"{id}": F.col("page_id").cast("string"), "{k}": k.cast("string"), "{off}": F.when(k % 2 == 0, " disabled").otherwise(""), "{on}": F.when(k >= 2, " checked").otherwise(""), "{open}": F.when(k == 1, " open").otherwise(""), "{pressed}": (k == 2).cast("string"), "{pad}": F.lit("0123456789" * 5), "{shape}": F.when(k == 0, "circle").when(k == 1, "poly").when(k == 2, "rect").otherwise("star")}
    html = F.lit(FORM)
    for name, value in words.items():
        html = F.replace(html, F.lit(name), value)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.alias("html"))


def _facts(spark, sf_dir):
    return facts.facts(nodes(_forms(spark, sf_dir))).withColumn("id", F.col("attrs")["id"])


def _stored_facts(spark, sf_dir):
    return stored(_facts(spark, sf_dir), "forms")


def form_states(spark, sf_dir):
    f = _facts(spark, sf_dir).where("id is not null")
    return f.select("page_id", "id", "role", "disabled", "checked", "selected", "required", F.coalesce(F.col("expanded").cast("string"), F.lit("")).alias("expanded"), "pressed", "clickable", "hidden")


def form_names(spark, sf_dir):
    f = _stored_facts(spark, sf_dir)
    n = facts.names(f)
    return f.where("id is not null and role in ('textbox', 'spinbutton', 'button', 'link', 'img', 'region', 'checkbox', 'dialog', 'treeitem')").join(n, ["page_id", "node"]).select("page_id", "id", "name", F.coalesce("source", F.lit("")).alias("source"))


def link_destinations(spark, sf_dir):
    return _facts(spark, sf_dir).where("role = 'link'").select("page_id", "id", F.array_join(facts.destination_tags(), ",").alias("tags"))


def progress_values(spark, sf_dir):
    return _facts(spark, sf_dir).where("role in ('progressbar', 'meter')").select("page_id", "id", facts.progress_value().alias("value"))


def field_errors(spark, sf_dir):
    f = _stored_facts(spark, sf_dir)
    return controls.error_texts(f, facts.readable(f)).join(f.select("page_id", "node", "id"), ["page_id", "node"]).select("page_id", "id", "error")


def blocked_controls(spark, sf_dir):
    f = _facts(spark, sf_dir).where("interactive")
    return controls.blocked(f.select("page_id", "node", "hidden", "disabled")).join(f.select("page_id", "node", "id"), ["page_id", "node"]).select("page_id", "id", "blocked_by", "may_clear")


def typable_fields(spark, sf_dir):
    f = _facts(spark, sf_dir).where("id in ('a', 'b', 'c', 'f', 'g', 's')")
    return f.select("page_id", "id", controls.accepts(F.col("role"), F.col("attrs")["readonly"].isNotNull(), F.col("disabled")).alias("takes"))


def label_contradictions(spark, sf_dir):
    f = _stored_facts(spark, sf_dir)
    return facts.contradictions(f).join(f.select("page_id", "node", "id"), ["page_id", "node"]).where("id is not null").select("page_id", "id", "verdict")


def form_tables(spark, sf_dir):
    return views.markdown_tables(views.tables_tsv(_stored_facts(spark, sf_dir))).select("page_id", "markdown")


def image_maps(spark, sf_dir):
    n = stored(geometry.map_nodes(nodes(_forms(spark, sf_dir))), "maps")
    images = n.where("tag = 'img'").select("page_id", "node", F.struct(F.lit(100.0).alias("x"), F.lit(10.0).alias("y"), F.lit(50.0).alias("w"), F.lit(60.0).alias("h")).alias("box"))
    return geometry.image_map_areas(n, images).select("page_id", "box.x", "box.y", "box.w", "box.h")


def _colours(spark, sf_dir):
    """Text colours and backgrounds from the numbers of events."""
    k = F.col("event_id")
    rgb = lambda a, b, c: F.struct(((k * a) % 256).cast("double").alias("r"), ((k * b) % 256).cast("double").alias("g"), ((k * c) % 256).cast("double").alias("b"), F.lit(1.0).alias("a"))
    grey = F.struct(*[((k * 29) % 256).cast("double").alias(c) for c in "rgb"], F.lit(1.0).alias("a"))
    white = F.struct(*[F.lit(255.0).alias(c) for c in "rgb"], F.lit(1.0).alias("a"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(k % 3 == 0, grey).otherwise(rgb(37, 91, 53)).alias("c"), white.alias("bg"))


def text_tones(spark, sf_dir):
    base = F.struct(*[F.lit(34.0).alias(c) for c in "rgb"], F.lit(1.0).alias("a"))
    return _colours(spark, sf_dir).select("event_id", F.coalesce(geometry.tone(F.col("c"), F.col("bg"), base, F.col("bg")), F.lit("")).alias("tone"))


def unseen_texts(spark, sf_dir):
    k = F.col("event_id")
    return _colours(spark, sf_dir).select("event_id", geometry.unseen_text(F.col("c"), F.col("bg"), (k % 5).cast("double"), F.when(k % 7 == 0, -999.0).otherwise(0.0)).alias("unseen"))


def primary_buttons(spark, sf_dir):
    e = _colours(spark, sf_dir)
    k = F.col("event_id")
    level = F.when(k % 11 == 0, 20.0).when(k % 2 == 0, 200.0).otherwise(205.0)
    fill = F.struct(*[level.alias(c) for c in "rgb"], F.lit(1.0).alias("a"))
    b = e.select(F.lit(0).alias("capture_id"), F.floor(k / F.when(k % 1000 < 500, 5).otherwise(2)).alias("parent"), (k % 1000 < 500).alias("kind"), k.alias("node"), fill.alias("fill"), F.when(k % 97 == 0, None).otherwise(F.col("bg")).alias("backdrop"))
    return geometry.primary_buttons(b.withColumn("parent", F.concat_ws(":", "parent", "kind"))).select("parent", "node")


def box_cells(spark, sf_dir):
    """Orders as tables drawn by boxes: three cells a line item, slightly out of line."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    cell = lambda i, text: F.struct(F.lit(i).alias("i"), text.cast("string").alias("text"))
    each = li.withColumn("line", n).select(F.col("l_orderkey").alias("table"), "line", F.explode(F.array(cell(0, F.col("l_partkey")), cell(1, F.col("l_suppkey")), cell(2, F.col("l_returnflag")))).alias("c"))
    box = F.struct((300.0 - F.col("c.i") * 100).alias("x"), (F.col("line") * 30.0 + F.col("c.i") * 4).alias("y"), F.lit(90.0).alias("w"), F.lit(20.0).alias("h"))
    return each.select(F.lit(0).alias("capture_id"), "table", (F.col("line") * 3 + F.col("c.i")).cast("int").alias("node"), F.col("c.text").alias("text"), box.alias("box"))


def tables_by_boxes(spark, sf_dir):
    return geometry.table_rows(box_cells(spark, sf_dir)).select("table", F.col("row").cast("long").alias("row"), "tsv")


def _fields(spark, sf_dir):
    """Customers as fields on a page each nation: a label left, an error below some."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("capture_id"), F.col("c_custkey").alias("k"))
    box = lambda x, y, w, h: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h"))
    y = F.col("k") * 100
    role = F.when(F.col("k") % 3 == 0, "checkbox").otherwise("textbox")
    fields = c.select("capture_id", F.col("k").alias("node"), box(F.lit(300), y, 100, 20).alias("box"), role.alias("role"), F.when(F.col("k") % 4 == 0, "named").otherwise("").alias("name"))
    labels = c.select("capture_id", (F.col("k") + 1_000_000_000).alias("node"), box(F.when(F.col("k") % 3 == 0, 410).otherwise(F.when(F.col("k") % 5 == 0, 20).otherwise(150)), y, 100, 20).alias("box"), F.when(F.col("k") % 8 == 0, "It is saved.").otherwise("Label").alias("text"), F.when(F.col("k") % 7 == 0, "red").otherwise("").alias("tone"))
    errors = c.select("capture_id", (F.col("k") + 2_000_000_000).alias("node"), box(F.lit(310), y + F.when(F.col("k") % 2 == 0, 30).otherwise(60), 90, 15).alias("box"), F.lit("Wrong").alias("text"), F.lit("red").alias("tone"))
    return fields, labels, errors


def label_association(spark, sf_dir):
    fields, labels, _ = _fields(spark, sf_dir)
    return geometry.label_pairs(fields, labels).select("capture_id", "control", "label")


def proximity_errors(spark, sf_dir):
    fields, _, errors = _fields(spark, sf_dir)
    return geometry.error_pairs(fields, errors).select("capture_id", "control", "label")


def modal_layers(spark, sf_dir):
    """A capture for each order: a wrapper, a dialog inside, a layer beside it."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("capture_id"))
    k = F.col("capture_id")
    box = lambda w: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), w.cast("double").alias("w"), F.lit(800.0).alias("h"))
    row = lambda node, parent, path, tag, role, modal, position, w: F.struct(F.lit(node).alias("node"), F.lit(parent).alias("parent"), F.array(*[F.lit(x) for x in path]).cast("array<int>").alias("path"), F.lit(tag).alias("tag"), F.lit(role).alias("role"), modal.alias("aria_modal"), position.alias("position"), box(w).alias("box"))
    no, flow = F.lit(False), F.lit("static")
    rows = F.array(row(0, -1, [], "body", "", no, flow, F.lit(1000)), row(1, 0, [0], "div", "", no, F.when(k % 2 == 0, "fixed").otherwise("static"), F.lit(900)), row(2, 1, [0, 1], "div", "dialog", k % 3 == 0, F.when(k % 5 == 0, "static").otherwise("absolute"), F.lit(300)), row(3, 1, [0, 1], "div", "", no, F.when(k % 7 == 0, "fixed").otherwise("static"), F.lit(1000)))
    nodes_ = o.select("capture_id", F.explode(rows).alias("r")).select("capture_id", "r.*").withColumn("hidden", F.lit(False))
    view = o.select("capture_id", F.lit(1000.0).alias("viewport_w"), F.lit(800.0).alias("viewport_h"))
    return geometry.modal_layers(nodes_, view).select("capture_id", "covers", F.coalesce("backdrop", F.lit(-1)).cast("long").alias("backdrop"))


QUERIES = {f.__name__: f for f in (form_states, form_names, link_destinations, progress_values, field_errors, blocked_controls, typable_fields, label_contradictions, form_tables, image_maps, text_tones, unseen_texts, primary_buttons, tables_by_boxes, label_association, proximity_errors, modal_layers)}

_P = "p as (select page_id, page_id % 4 as k from pages)"
# (id, role, disabled, checked, selected, required, expanded, pressed, clickable), k the page's remainder by 4
_STATES = [
    ("form", "form"), ("fs", "group", "k % 2 = 0"), ("l1", ""), ("a", "textbox"), ("b", "textbox", "k % 2 = 0"), ("c", "checkbox", "k % 2 = 0", "k >= 2"), ("d", "listbox", "k % 2 = 0"), ("e", "option", "k % 2 = 0", "false", "true"),
    ("f", "textbox", "false", "false", "false", "true"), ("err", ""), ("g", "spinbutton"), ("h", "button"), ("i", "button", "false", "false", "false", "false", "case when k = 1 then 'true' else 'false' end"), ("j", "button", "false", "false", "false", "false", "''", "k = 2"),
    ("k", "", *["false"] * 4, "''", "false", "true"), ("l", "", *["false"] * 4, "''", "false", "true"), ("l2", ""), ("m", ""), ("n", "", *["false"] * 4, "''", "false", "true"), ("o", "link"), ("p", "link"), ("q", "progressbar"), ("r", "meter"), ("s", "textbox"), ("t", ""), ("t2", "heading"),
    ("u", "img"), ("v", ""), ("w", "link"), ("x", "region"), ("j2", ""), ("tab", "table"), ("th", "rowgroup"), ("x1", "rowheader"), ("x2", "columnheader"), ("x3", "cell"), ("y", "status"), ("z", "listitem"),
    ("q2", "progressbar"), ("q3", "progressbar"), ("q4", "progressbar"), ("q5", "meter"), ("q6", "meter"), ("o2", "link"), ("f1", ""), ("f2", ""), ("h2", "button"), ("h3", "button"), ("h4", "textbox"), ("d1", "dialog"), ("j3", "button"), ("z2", "treeitem"),
]
_FULL = [(*s, *(["false"] * 4 + ["''", "false", "false"])[len(s) - 2 :]) for s in _STATES]
_RGB = """k as (select event_id, case when event_id % 3 = 0 then [event_id * 29 % 256, event_id * 29 % 256, event_id * 29 % 256] else [event_id * 37 % 256, event_id * 91 % 256, event_id * 53 % 256] end as c from events),
n as (select event_id, c[1] / 255.0::double as r, c[2] / 255.0::double as g, c[3] / 255.0::double as b from k),
m as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from n),
h as (select event_id, (hi + lo) / 2 as l, case when hi = lo then 0 when (hi + lo) / 2 > 0.5 then (hi - lo) / (2 - hi - lo) else (hi - lo) / (hi + lo) end as s,
 case when hi = lo then 0 when hi = r then 60 * case when (g - b) / (hi - lo) < 0 then (g - b) / (hi - lo) + 6 else (g - b) / (hi - lo) end when hi = g then 60 * ((b - r) / (hi - lo) + 2) else 60 * ((r - g) / (hi - lo) + 4) end as h,
 0.2126 * case when r <= 0.03928 then r / 12.92 else pow((r + 0.055) / 1.055, 2.4) end + 0.7152 * case when g <= 0.03928 then g / 12.92 else pow((g + 0.055) / 1.055, 2.4) end + 0.0722 * case when b <= 0.03928 then b / 12.92 else pow((b + 0.055) / 1.055, 2.4) end as y from m)"""
_NATIVE = "select c_nationkey as capture_id, c_custkey as k from customer"

ORACLE_SQL = {
    "form_states": f"with {_P} " + " union all ".join(f"select page_id, '{i}' as id, '{r}' as role, {d} as disabled, {c} as checked, {s} as selected, {q} as required, {e} as expanded, {x} as pressed, {y} as clickable, {'true' if i == 'f2' else 'false'} as hidden from p" for i, r, d, c, s, q, e, x, y in _FULL),
    "form_names": f"with {_P} " + " union all ".join(f"select page_id, '{i}' as id, {n} as name, '{s}' as source from p" for i, n, s in [("a", "''", ""), ("b", "''", ""), ("c", "''", ""), ("f", "'Mail of ' || page_id", "label"), ("g", "'Age ' || k", "label"), ("h", "'Send ' || page_id", "value"), ("i", "'More'", "content"), ("j", "'Star ' || k", "aria-label"), ("o", "'write'", "content"), ("p", "'get ' || page_id", "content"), ("s", "''", ""), ("u", "'Pic ' || page_id", "alt"), ("w", "''", ""), ("x", "'by ' || page_id", "labelledby"), ("h2", "'Submit'", "default"), ("h3", "'Go ' || k", "alt"), ("h4", "'T ' || page_id", "title"), ("d1", "'Head ' || page_id", "heading"), ("j3", "'Star ' || k || ' by ' || page_id", "labelledby"), ("o2", "'call'", "content"), ("z2", "''", "")]),
    "link_destinations": f"with {_P} select page_id, 'o' as id, 'href=mailto:me@host' || page_id || '.org' as tags from p union all select page_id, 'p', 'download' from p union all select page_id, 'w', '' from p union all select page_id, 'o2', left('href=TEL:+' || page_id || '-' || repeat('0123456789', 5), 54) || '…' from p",
    "progress_values": f"with {_P} select page_id, 'q' as id, 25 * k || '%' as value from p union all select page_id, 'r', 10 * k || '%' from p union all select page_id, 'q2', '' from p union all select page_id, 'q3', chr(34) || k || ' of ' || chr(92) || chr(34) || '4' || chr(92) || chr(34) || chr(34) from p union all select page_id, 'q4', floor(100 * least(page_id / 200.0::double, 1.0::double) + 0.5)::bigint || '%' from p union all select page_id, 'q5', '' from p union all select page_id, 'q6', '2.5' from p",
    "field_errors": "select page_id, 'f' as id, 'Bad' as error from pages",
    "blocked_controls": f"with {_P} " + " union all ".join(f"select page_id, '{i}' as id, 'disabled' as blocked_by, true as may_clear from p where k % 2 = 0" for i in "bcde"),
    "typable_fields": f"with {_P} " + " union all ".join(f"select page_id, '{i}' as id, {t} as takes from p" for i, t in [("a", "'typable'"), ("b", "case when k % 2 = 0 then 'disabled' else 'typable' end"), ("c", "'not a field'"), ("f", "'typable'"), ("g", "'typable'"), ("s", "'typable'")]),
    "label_contradictions": f"with {_P} select page_id, 'j' as id, 'differs' as verdict from p union all select page_id, 'j3', 'differs' from p union all " + " union all ".join(f"select page_id, '{i}', 'unlabelled' from p" for i in ("a", "b", "c", "d", "s", "w", "z2")),
    "form_tables": f"with {_P} select page_id, '| R | C \\| ' || k || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| v' || page_id || ' |  |' as markdown from p",
    "image_maps": f"with {_P} select page_id, 100 + case k when 0 then -30.0 when 1 then 1.0 when 2 then 2.0 else 0.0 end::double as x, 10 + case k when 0 then -28.0 when 1 then 2.0 when 2 then 2.0 else 0.0 end::double as y, case k when 0 then 60.0 when 1 then 29.0 when 2 then 28.0 else 50.0 end::double as w, case k when 0 then 60.0 when 1 then 38.0 when 2 then 38.0 else 60.0 end::double as h from p",
    "text_tones": f"with {_RGB} select event_id, case when s >= 0.5 and l between 0.2 and 0.7 and (h <= 15 or h >= 340) then 'red' when s >= 0.4 and l between 0.15 and 0.65 and h between 85 and 165 then 'green' when s <= 0.2 and 1.05 / (y + 0.05) >= 1.5 and 1.05 / (y + 0.05) < 0.4 * 1.05 / (pow((34 / 255.0::double + 0.055) / 1.055, 2.4) + 0.05) then 'muted' else '' end as tone from h",
    "unseen_texts": f"with {_RGB} select event_id, event_id % 5 <= 1 or event_id % 7 = 0 or 1.05 / (y + 0.05) < 1.1 as unseen from h",
    "primary_buttons": """
with e as (select event_id as node, event_id // (case when event_id % 1000 < 500 then 5 else 2 end) || ':' || (event_id % 1000 < 500) as parent, (case when event_id % 11 = 0 then 20 when event_id % 2 = 0 then 200 else 205 end) as f from events where event_id % 97 <> 0),
g as (select *, count(*) over (partition by parent) as n, count(*) filter (f = 20) over (partition by parent) as dark from e)
select parent, node from g where (n >= 3 and ((dark = 1 and f = 20) or (dark = n - 1 and f <> 20))) or (n = 2 and dark = 1 and f = 20)""",
    "tables_by_boxes": "select l_orderkey as \"table\", row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 as row, l_returnflag || chr(9) || l_suppkey || chr(9) || l_partkey as tsv from lineitem",
    "label_association": f"with c as ({_NATIVE}) select capture_id, k as control, k + 1000000000 as label from c where k % 7 <> 0 and k % 8 <> 0 and (k % 3 = 0 or k % 5 <> 0)",
    "proximity_errors": f"with c as ({_NATIVE}) select capture_id, k as control, k + 2000000000 as label from c where k % 2 = 0",
    "modal_layers": """
with o as (select o_orderkey as k from orders), d as (select k, k % 3 = 0 as aria, k % 5 <> 0 as layered, case when k % 2 = 0 then 1 when k % 5 <> 0 and k % 7 = 0 then 3 end as backdrop from o)
select k as capture_id, backdrop is not null as covers, coalesce(backdrop, -1)::bigint as backdrop from d where (aria or layered) and (aria or backdrop is not null)""",
}
