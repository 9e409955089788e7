"""Registered queries on captures of varied shape: each user's events become one capture.

Event k of a user is node k. Its parent is k without its lowest set bit, so subtrees are runs
of nodes; boxes, styles and colours come from the event's own number and value.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscan.operators import covers, geometry, visibility

FILLS = ("rgba(0, 0, 0, 0)", "rgb(255, 255, 255)", "rgba(10, 20, 30, 0.5)", "rgba(200, 0, 0, 0.25)", "rgb(20, 20, 20)", "", "rgba(0, 0, 0, 0)", "rgba(250, 250, 250, 0.75)")
INKS = ("rgb(0, 0, 0)", "rgb(255, 255, 255)", "rgba(0, 0, 0, 0.03)", "rgb(20, 20, 20)", "rgb(132, 137, 142)", "odd")
PAGE = {"content_w": 420.0, "content_h": 500.0, "viewport_w": 300.0, "viewport_h": 520.0}


def _pick(values, k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def captures(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    n = F.count("*").over(Window.partitionBy("user_id"))
    rows = e.select(F.col("user_id").alias("capture_id"), k.alias("node"), n.cast("int").alias("_n"), F.get_json_object("props", "$.k").cast("int").alias("p"), F.col("event_id").alias("q"))
    node, p, q = F.col("node"), F.col("p"), F.col("q")
    number = lambda c: c.cast("double")
    box = F.struct(number(p * 17 % 600 - 150).alias("x"), number(q * 31 % 700 - 100).alias("y"), number(q * 13 % 400).alias("w"), number(1 + p * 7 % 200).alias("h"))
    style = F.struct(
        F.when(q % 7 == 0, "hidden").when(q % 7 == 1, "auto").when(q % 7 == 2, "clip").otherwise("visible").alias("overflow_x"),
        F.when(p % 6 == 0, "hidden").when(p % 6 == 1, "scroll").otherwise("visible").alias("overflow_y"),
        F.when(p % 11 == 0, "fixed").otherwise("static").alias("position"),
        F.when(q % 41 == 0, "inset(50%)").otherwise("none").alias("clip_path"),
        _pick(INKS, q).alias("color"),
        _pick(FILLS, p).alias("background_color"),
        F.when(q % 37 == 0, "url(x)").otherwise("none").alias("background_image"),
        F.when(q % 13 == 0, "text").otherwise("border-box").alias("background_clip"),
        F.when(q % 17 == 0, "1px").otherwise("16px").alias("font_size"),
        F.when(q % 31 == 0, "-600px").otherwise("0px").alias("text_indent"),
    )
    low = node.bitwiseAND(-node)
    end = F.when(node == 0, F.col("_n")).otherwise(F.least(node + low, F.col("_n")))
    return rows.select(
        "capture_id", node.cast("int").alias("node"), F.when(node > 0, node.bitwiseAND(node - 1)).cast("int").alias("parent"), end.cast("int").alias("end"),
        F.when((node % 2 == 1) & (p % 5 != 0), "text").otherwise("element").alias("kind"), F.when(node == 0, "html").when(node == 64, "body").otherwise("div").alias("tag"),
        F.when(q % 11 == 0, " ").otherwise(q.cast("string")).alias("text"), (q % 29 == 0).alias("hidden"), (q % 23 != 0).alias("laid"), box.alias("box"), style.alias("style"), F.when(q % 19 == 0, "rgba(0, 0, 120, 0.5)").otherwise("").alias("background"), "p", "q",
    )


def _pages(drawn):
    return drawn.select("capture_id").distinct().select("capture_id", *[F.lit(v).alias(c) for c, v in PAGE.items()])


def reachable_boxes(spark, sf_dir):
    """Which boxes are off-screen, clipped, or hold something in reach though they are."""
    d = captures(spark, sf_dir)
    return visibility.reach(d, _pages(d)).select("capture_id", F.col("node").cast("long").alias("node"), "offscreen", "clipped", "holds")


def text_backdrops(spark, sf_dir):
    """The colour behind each text, in full numbers."""
    b = visibility.backdrops(captures(spark, sf_dir)).where("kind = 'text'")
    return b.select("capture_id", F.col("node").cast("long").alias("node"), *[F.round(F.coalesce(f"backdrop.{c}", F.lit(-1.0)), 6).alias(c) for c in "rgb"])


def unread_texts(spark, sf_dir):
    """Texts that nobody can read, and why, from the capture alone."""
    d = captures(spark, sf_dir)
    return visibility.unseen_texts(d, _pages(d)).select("capture_id", F.col("node").cast("long").alias("node"), F.coalesce("why", F.lit("")).alias("why"))


def layered_lines(spark, sf_dir):
    """Every twelfth event as a dialog: its lines first, in the order of paint."""
    d = captures(spark, sf_dir)
    q = F.col("q")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("q"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("int").alias("node"))
    dialogs = events.where(q % 12 == 5).select("capture_id", "node", (q * 17 % 50).alias("paint"))
    depth = F.bit_count("node").cast("int")
    out = geometry.layer_order(d.select("capture_id", "node", "parent", "end", depth.alias("indent")), dialogs)
    return out.select("capture_id", F.col("node").cast("long").alias("node"), F.coalesce("layer", F.lit(-1)).cast("long").alias("layer"), F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"))


def inert_boxes(spark, sf_dir):
    """What the native dialog painted last covers, beside what is covered already."""
    d = captures(spark, sf_dir).withColumn("visible", F.col("laid") & ~F.col("hidden"))
    paint = (F.col("node") * 7 % 5).alias("paint")
    natives = d.where("node % 9 = 4 and kind = 'element' and visible").select("capture_id", "node", "end", paint)
    covered = d.where("node % 10 = 3").select("capture_id", "node", F.lit(-7).alias("coverer"))
    return geometry.inert_behind(d, natives, covered).select("capture_id", F.col("node").cast("long").alias("node"), F.col("coverer").cast("long").alias("coverer"))


def unseen_reports(spark, sf_dir):
    """What nobody can read of each capture, quoted within 120 tokens."""
    d = captures(spark, sf_dir).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), F.col("node") % 90))
    return visibility.unseen_report(visibility.unseen_texts(d, _pages(d)), _pages(d), 120)


def cover_reasons(spark, sf_dir):
    """What takes the clicks meant for covered boxes, painted or not, and whether it may go."""
    q, node = F.col("q"), F.col("node")
    up = F.filter(F.sequence(F.lit(0), node), lambda a: (a < node) & (F.when(a == 0, F.lit(1 << 20)).otherwise(a + a.bitwiseAND(-a)) > node))
    d = captures(spark, sf_dir).withColumns({"path": up.cast("array<int>"), "visible": F.col("laid") & ~F.col("hidden")})
    boxes = d.where("visible and kind = 'element'").withColumns({"paint": (q * 7 % 50).cast("int"), "paints": q % 4 != 3})
    ref = F.when(q % 6 == 0, F.concat(F.lit("b"), node.cast("string"))).otherwise("")
    sides = d.select("capture_id", "node", "end", "path", F.when(q % 14 == 1, "iframe").otherwise("div").alias("tag"), F.when(q % 21 == 2, "dialog").otherwise("").alias("role"), ref.alias("ref"), (F.col("p") % 3 == 0).alias("painted"), "box")
    texts = d.where("visible and kind = 'text' and trim(text) <> '' and q % 5 = 0").select("capture_id", "node", "path", "text")
    out = covers.reasons(geometry.occluded(boxes), sides, texts)
    return out.select("capture_id", node.cast("long").alias("node"), F.col("coverer").cast("long").alias("coverer"), "why", "may_clear", "said")


QUERIES = {f.__name__: f for f in (reachable_boxes, text_backdrops, unread_texts, layered_lines, inert_boxes, unseen_reports, cover_reasons)}

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_FILL = [(0, 0, 0, 0), (255, 255, 255, 1), (10, 20, 30, 0.5), (200, 0, 0, 0.25), (20, 20, 20, 1), (0, 0, 0, 0), (0, 0, 0, 0), (250, 250, 250, 0.75)]
_INK = [(0, 0, 0, 1), (255, 255, 255, 1), (0, 0, 0, 0.03), (20, 20, 20, 1), (132, 137, 142, 1)]
_RGBA = lambda rows: "[" + ", ".join("[" + ", ".join(f"{x}::double" for x in r) + "]" for r in rows) + "]"
NODES_SQL = f"""e as (select user_id as c, row_number() over (partition by user_id order by event_id) - 1 as k, count(*) over (partition by user_id) as n, (props ->> '$.k')::int as p, event_id as q from events),
d as (select c, k, case when k = 0 then n else least(k + (k & -k), n) end as e, p, q, case when k % 2 = 1 and p % 5 <> 0 then 'text' else 'element' end as kind, k in (0, 64) as own, q % 29 = 0 as hidden, q % 23 <> 0 as laid,
 p * 17 % 600 - 150 as x, q * 31 % 700 - 100 as y, q * 13 % 400 as w, 1 + p * 7 % 200 as h, q % 7 in (0, 2) as cx, p % 6 = 0 as cy, q % 7 = 1 or p % 6 = 1 as scrolls, p % 11 = 0 as fixed, q % 41 = 0 as cut,
 {_RGBA(_FILL)}[p % {len(FILLS)} + 1] as fill, q % 37 = 0 as image, q % 19 = 0 as blended from e),
u as (select c, a.k as ak, b.k as bk from d a join d b using (c) where a.k < b.k and b.k < a.e),
o as (select *, laid and not hidden and ((x + w <= 0 and w > 0) or x + w < 0 or y + h <= 0 or x >= 420 or y >= 520) as beyond from d),
r as (select b.c, b.k, b.e, b.laid and not b.hidden as shown, b.w > 0 and b.h > 0 and (b.w > 1 or b.h > 1) as solid,
  b.beyond and not exists (select 1 from u join o a on a.c = u.c and a.k = u.ak where u.c = b.c and u.bk = b.k and a.kind = 'element' and a.laid and not a.own and a.scrolls and not a.beyond) as off,
  b.laid and not b.hidden and (b.cut or exists (select 1 from u join o a on a.c = u.c and a.k = u.ak where u.c = b.c and u.bk = b.k and (
    (a.cut and a.kind = 'element') or (a.kind = 'element' and a.laid and not a.own and ((a.cx and (b.x >= a.x + a.w or b.x + b.w <= a.x)) or (a.cy and (b.y >= a.y + a.h or b.y + b.h <= a.y)))
      and not b.fixed and not exists (select 1 from u v join o f on f.c = v.c and f.k = v.ak where v.c = b.c and v.bk = b.k and f.k > a.k and f.fixed))))) as cl from o b),
g as (select r.*, (off or cl) and exists (select 1 from r s where s.c = r.c and s.k > r.k and s.k < r.e and s.shown and s.solid and not s.off and not s.cl) as holds from r)"""
_SHADE = f"""l as (select d.c, d.k, a.k as ak, a.blended, a.kind, a.image and a.kind = 'element' as image, case when a.blended then [0::double, 0::double, 120::double, 0.5::double] when a.kind = 'element' then a.fill else [0::double, 0::double, 0::double, 0::double] end as f from d join (select c, ak, bk from u union all select c, k, k from d) z on z.c = d.c and z.bk = d.k join d a on a.c = d.c and a.k = z.ak where d.kind = 'text'),
s as (select c, k, coalesce(max(ak) filter (blended or image or f[4] >= 1), -1) as stop from l group by all),
t as (select s.c, s.k, any_value(case when l.ak = s.stop and not l.blended and l.image then true end) as unknown,
  list_reduce(list_concat([[255::double, 255::double, 255::double, 1::double]], coalesce(list(l.f order by l.ak) filter (l.ak >= s.stop and l.f[4] > 0), [])), lambda x, y: [y[1] * y[4] + x[1] * (1 - y[4]), y[2] * y[4] + x[2] * (1 - y[4]), y[3] * y[4] + x[3] * (1 - y[4]), 1::double]) as bg from s join l using (c, k) group by all),
b as (select c, k, case when unknown then null else bg end as bg from t)"""
_LINEAR = lambda x: f"(case when {x} / 255 <= 0.03928 then {x} / 255 / 12.92 else pow(({x} / 255 + 0.055) / 1.055, 2.4) end)"
_LUM = lambda v: f"(0.2126 * {_LINEAR(f'{v}[1]')} + 0.7152 * {_LINEAR(f'{v}[2]')} + 0.0722 * {_LINEAR(f'{v}[3]')})"

ORACLE_SQL = {
    "reachable_boxes": f"with {NODES_SQL} select c as capture_id, k as node, off and not holds as offscreen, cl and not holds as clipped, holds from g",
    "layered_lines": f"""with {NODES_SQL},
m as (select c, k, q * 17 % 50 as paint from d where q % 12 = 5),
i as (select d.c, d.k, max(m.k) as layer from d left join (select c, ak, bk from u union all select c, k, k from d) z on z.c = d.c and z.bk = d.k left join m on m.c = d.c and m.k = z.ak group by all)
select i.c as capture_id, i.k as node, coalesce(layer, -1) as layer, row_number() over (partition by i.c order by m.paint desc nulls last, coalesce(layer, -1), i.k) - 1 as pos, bit_count(i.k)::bigint - case when layer is null then 0 else bit_count(layer) end::bigint as level from i left join m on m.c = i.c and m.k = i.layer""",
    "inert_boxes": f"""with {NODES_SQL},
t as (select c, k as top, e as upto from d where k % 9 = 4 and kind = 'element' and laid and not hidden qualify row_number() over (partition by c order by k * 7 % 5 desc, k) = 1)
select c as capture_id, k as node, -7 as coverer from d where k % 10 = 3
union all select d.c, d.k, top from d join t using (c) where d.kind = 'element' and d.laid and not d.hidden and d.w > 0 and not d.own and d.k % 10 <> 3 and d.k <> top and not (d.k > top and d.k < upto) and not exists (select 1 from u where u.c = d.c and u.ak = d.k and u.bk = top)""",
    "text_backdrops": f"with {NODES_SQL}, {_SHADE} select c as capture_id, k as node, " + ", ".join(f"round(coalesce(bg[{i}], -1), 6) as {x}" for i, x in enumerate("rgb", 1)) + " from b",
    "unread_texts": f"""with {NODES_SQL}, {_SHADE},
h as (select g.c, g.k, g.off and not g.holds as off, g.cl and not g.holds as cl, d.q, {_RGBA(_INK)}[d.q % {len(INKS)} + 1] as ink, b.bg, exists (select 1 from u join d a on a.c = u.c and a.k = u.ak where u.c = g.c and u.bk = g.k and a.kind = 'element' and a.q % 13 = 0 and (a.image or a.fill[4] > 0)) as through
 from g join d using (c, k) left join b using (c, k) where d.kind = 'text' and not d.hidden and d.q % 11 <> 0),
i as (select *, [ink[1] * ink[4] + bg[1] * (1 - ink[4]), ink[2] * ink[4] + bg[2] * (1 - ink[4]), ink[3] * ink[4] + bg[3] * (1 - ink[4])] as seen from h),
j as (select *, {_LUM("seen")} as lf, {_LUM("bg")} as lb from i)
select c as capture_id, k as node, coalesce(case when off then 'offscreen' when cl then 'clipped' when q % 17 = 0 then 'tiny' when q % 31 = 0 then 'indented' when through then null when ink[4] <= 0.05 then 'transparent' when (greatest(lf, lb) + 0.05) / (least(lf, lb) + 0.05) < 1.1 then 'camouflaged' end, '') as why from j""",
}
ORACLE_SQL["unseen_reports"] = f"""
with w as ({ORACLE_SQL["unread_texts"]}), e as (select user_id as c, row_number() over (partition by user_id order by event_id) - 1 as k, event_id as q from events),
l as (select w.capture_id as c, k, trim(repeat(q || ' ', k % 90)) as t from w join e on e.c = w.capture_id and e.k = w.node where why <> ''),
m as (select c, k, '  "' || case when length(t) > 300 then left(t, 300) || '…' else t end || '"' as line from l),
u as (select *, sum(strlen(line) + 1) over (partition by c order by k) as used, row_number() over (partition by c order by k) as i from m),
r as (select c, count(*) as n, count(*) filter (used > 480 and i > 1) as dropped, string_agg(line, chr(10) order by k) filter (used <= 480 or i = 1) as body from u group by 1)
select a.c as capture_id, coalesce(n, 0) as n_unseen, coalesce('{visibility.UNSEEN_BEGIN}' || chr(10) || body || case when dropped > 0 then chr(10) || '… ' || dropped || ' more lines' else '' end || chr(10) || 'unseen-text end', '{visibility.NOTHING_UNSEEN}') as report
from (select distinct user_id as c from events) a left join r using (c)"""
ORACLE_SQL["cover_reasons"] = f"""with {NODES_SQL},
v as (select *, q * 7 % 50 as paint, q % 4 <> 3 as takes from d where laid and not hidden and kind = 'element' and w > 0),
z as (select c, k, paint, x, y, w, h, unnest(case when w < 4 or h < 4 then [0] else [0, 1, 2, 3, 4] end) as i, w < 4 or h < 4 as small from v),
t as (select c, k, paint, i, small, case i when 0 then x + w / 2.0::double when 1 then x + 1 when 2 then x + w - 1 when 3 then x + 1 else x + w - 1 end as px, case i when 0 then y + h / 2.0::double when 1 then y + 1 when 2 then y + 1 else y + h - 1 end as py from z),
rr as (select t.c, t.k, t.i, t.small, j.k as j, j.paint as jp from t join v j on j.c = t.c and j.takes and j.paint > t.paint and t.px >= j.x and t.px < j.x + j.w and t.py >= j.y and t.py < j.y + j.h
  where j.k <> t.k and not exists (select 1 from u where u.c = t.c and ((u.ak = t.k and u.bk = j.k) or (u.ak = j.k and u.bk = t.k)))),
oo as (select c, k, arg_max(j, jp * 1000 - j) filter (i = 0) as j from rr group by c, k, small having count(distinct i) = case when small then 1 else 5 end),
s as (select o.c, o.k, o.j, string_agg(x.q::varchar, ' ' order by x.k) as said from oo o join u on u.c = o.c and u.ak = o.j join d x on x.c = o.c and x.k = u.bk where x.kind = 'text' and x.laid and not x.hidden and x.q % 11 <> 0 and x.q % 5 = 0 group by all),
n as (select distinct o.c, o.k, o.j from oo o join d b on b.c = o.c and b.k = o.k join (select c, ak, bk from u union all select c, k, k from d) y on y.c = o.c and y.bk = o.j join d g on g.c = o.c and g.k = y.ak
  where g.p % 3 = 0 and not exists (select 1 from u where u.c = o.c and u.ak = g.k and u.bk = o.k) and b.x + b.w / 2.0::double between g.x and g.x + g.w and b.y + b.h / 2.0::double between g.y and g.y + g.h),
w as (select o.c, o.k, o.j, m.q, s.said, case when m.q % 14 = 1 then 'frame' when m.q % 6 = 0 then 'control' when s.said is not null then 'text' when n.k is not null then 'layer' else 'invisible' end as why,
  m.q % 21 = 2 or exists (select 1 from u join d a on a.c = u.c and a.k = u.ak where u.c = o.c and u.bk = o.j and a.q % 21 = 2) as dialog
  from oo o join d m on m.c = o.c and m.k = o.j left join s on s.c = o.c and s.k = o.k and s.j = o.j left join n on n.c = o.c and n.k = o.k and n.j = o.j)
select c as capture_id, k as node, j as coverer, why, why in ('control', 'text', 'layer') and not dialog as may_clear, case why when 'control' then 'b' || j when 'text' then case when length(said) > 60 then left(said, 59) || '…' else said end else '' end as said from w"""
