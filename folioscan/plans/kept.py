"""Registered queries on what is written and kept: tables and outlines as text, kept state, refs
bound again by position, and numbers that end with idle sessions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscan.operators import changes, facts, geometry, tree
from folioscan.plans import drawn, forms, outlines
from folioscan.sources import sinks
from folioscan.sources.markup import nodes
from folioscan.sources.stored import dealt, shared_path, stored
from folioscan.streaming import expiring
from folioscan.streaming.runs import run_available, run_closed, table_stream

SMALL_STATE = 3000


def written_tables(spark, sf_dir):
    """Tables found by their boxes, written as tab-separated text and read back."""
    path = shared_path(spark, "sinks/tables")
    rows = geometry.table_rows(forms.box_cells(spark, sf_dir)).select(F.col("table").alias("page_id"), F.lit(0).alias("table"), "row", "tsv")
    sinks.write_tables(rows, path)
    return sinks.read_tables(spark, path)


def written_outlines(spark, sf_dir):
    """Lines of documents, written as indented text and read back."""
    path = shared_path(spark, "sinks/outlines")
    sinks.write_outlines(outlines.document_lines(spark, sf_dir).withColumnRenamed("doc_id", "page_id"), path)
    return sinks.read_outlines(spark, path)


def kept_files(spark, sf_dir):
    """A state file for each user, some cut short, some too large: sites read, or why none."""
    path = shared_path(spark, "states")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    site = F.struct(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("seen"), F.array_sort(F.collect_set(F.array(F.col("event_type"), F.lit("1")))).alias("items"))
    sites = e.groupBy("user_id", F.concat(F.lit("https://s"), (F.col("event_id") % 3).cast("string")).alias("origin")).agg(site.alias("site"))
    whole = sites.groupBy("user_id").agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("origin", "site")))).alias("storage"), F.array().cast("array<struct<name:string>>").alias("cookies"))).alias("text"))
    k = F.col("user_id") % 10
    text = F.when(k == 3, F.expr("left(text, 20)")).when(k == 4, F.concat("text", F.repeat(F.lit(" "), F.lit(SMALL_STATE)))).when(k == 5, "").otherwise(F.col("text"))
    files = whole.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), text.alias("value"))
    dealt(files, "name").write.partitionBy("name").option("lineSep", "\n").text(path)
    storage, unreadable = sinks.read_kept(spark, path, SMALL_STATE)
    name = F.regexp_extract("file", r"name=u(-?\d+)/", 1).cast("long").alias("user_id")
    good = storage.select(name, "origin", F.size("items").cast("long").alias("items"), F.lit("").alias("why"))
    return good.unionByName(unreadable.select(name, F.lit("").alias("origin"), F.lit(0).cast("long").alias("items"), "why"))


def element_positions(spark, sf_dir):
    d = drawn.captures(spark, sf_dir).withColumn("tag", F.col("kind"))
    return tree.position_paths(d.select("capture_id", "node", "parent", "end", "tag"), ("capture_id",)).select("capture_id", F.col("node").cast("long").alias("node"), "position")


def rebound_links(spark, sf_dir):
    """Links of a page looked up in the page with one more list item in front, by name and, of
    equal names, by position."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    later = pages.select("page_id", F.replace("html", F.lit("<ul>"), F.lit("<ul><li><a href=/new>new</a></li>")).alias("html"))

    def links(rows, name):
        f = stored(facts.facts(nodes(rows)), name)
        placed = tree.position_paths(f.select("page_id", "node", "parent", "end", "tag", "role")).where("role = 'link'")
        at = F.row_number().over(Window.partitionBy("page_id").orderBy("node"))
        return placed.join(facts.names(f).select("page_id", "node", "name"), ["page_id", "node"]).select("page_id", "role", "name", "tag", F.lit("").alias("stable"), at.cast("long").alias("at"), "position")

    lost, found = links(pages, "earlier"), links(later, "later")
    bound = changes.rebind(lost.withColumn("ref", F.col("at")), found.withColumnRenamed("at", "node"))
    return bound.select("page_id", "ref", (F.col("node") - 1).alias("bound"), F.col("matches").cast("long").alias("matches"))


def _on_keyed_store(spark, run):
    """Run a stream of keyed state on the state store that it needs."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, expiring.STORE)
    try:
        return run()
    finally:
        spark.conf.set(conf, before)


def _run_keyed(spark, stream, name):
    return _on_keyed_store(spark, lambda: run_available(stream, name))


def _sighted(spark, sf_dir):
    e = table_stream(spark, f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("session_id"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))


def stream_numbers_until_idle(spark, sf_dir):
    """Nodes numbered as they are first seen, anew after six idle hours, by keyed state that
    goes with the session."""
    seen = _sighted(spark, sf_dir).select("session_id", F.lit("d").alias("document"), F.col("event_type").alias("kind"), (F.col("k") % 10).alias("backend"), "seq", F.lit(0).alias("pos"), "ts")
    out = _run_keyed(spark, expiring.numbered_until_idle(seen, timedelta(hours=6), "40 days"), "numbers")
    return out.select("session_id", "epoch", "kind", "backend", "number")


def stream_in_force(spark, sf_dir):
    """Events of the document in force, which views set as the stream goes."""
    kind = F.when(F.col("event_type") == "view", "navigate").when(F.col("event_type") == "error", "console-error").when(F.col("event_type") == "click", "dialog").otherwise(F.col("event_type"))
    seen = _sighted(spark, sf_dir).select("session_id", "seq", F.concat(F.lit("d"), (F.col("k") % 3).cast("string")).alias("document"), kind.alias("kind"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("text"), "ts")
    return _run_keyed(spark, expiring.arriving_in_force(seen, timedelta(days=400), "40 days"), "in-force").select("session_id", "seq", "document", "kind", "text")


def stream_outermost_toasts(spark, sf_dir):
    """Messages that came and went: nodes 4 to 7 stand in nodes 0 to 3, errors drain."""
    node = F.col("k") % 8
    what = F.when(F.col("event_type") == "error", "drain").when(F.col("event_type") == "click", "remove").otherwise("add")
    seen = _sighted(spark, sf_dir).select("session_id", "seq", what.alias("what"), node.alias("node"), F.when(node >= 4, F.array(node - 4)).otherwise(F.array().cast("array<long>")).alias("inside"), F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("k") % 4).cast("string"))).alias("text"), "ts")
    return _run_keyed(spark, expiring.outermost_toasts(seen, timedelta(days=400), "40 days"), "outermost").select("session_id", "seq", "text")


def stream_ended_sessions(spark, sf_dir):
    """Sessions that were stopped, lost their last holder or were idle: views hold, clicks
    release, purchases are requests that searches, sign-ups and some errors complete, other
    errors stop or use."""
    k = F.col("k")
    kind = F.col("event_type")
    what = F.when(kind == "view", "hold").when(kind == "click", "release").when(kind == "purchase", "start").when(kind != "error", "done").when(k % 3 == 0, "stop").when(k % 3 == 1, "done").otherwise("use")
    who = F.when(kind.isin("view", "click"), F.concat(F.lit("h"), (k % 2).cast("string"))).otherwise("r")
    uses = _sighted(spark, sf_dir).select("session_id", "seq", what.alias("what"), who.alias("who"), "ts")
    run = lambda: run_closed(uses, lambda u: expiring.ended_sessions(u, timedelta(hours=12), timedelta(hours=2), "40 days"), "ended")
    return _on_keyed_store(spark, run).select("session_id", "opened", "ended", "why", "busy")


QUERIES = {f.__name__: f for f in (written_tables, written_outlines, kept_files, element_positions, rebound_links, stream_numbers_until_idle, stream_in_force, stream_outermost_toasts, stream_ended_sessions)}

ORACLE_SQL = {
    "written_tables": "select l_orderkey as page_id, 0::bigint as \"table\", row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 as row, l_returnflag || chr(9) || l_suppkey || chr(9) || l_partkey as tsv from lineitem",
    "written_outlines": f"{outlines.LINES_SQL} select doc_id as page_id, pos::bigint as pos, repeat('  ', indent) || regexp_replace(line, '[\\r\\n]+', ' ', 'g') as line from a",
    "kept_files": """
with s as (select user_id, 'https://s' || event_id % 3 as origin, count(distinct event_type) as items from events group by all)
select user_id, origin, items, '' as why from s where user_id % 10 not in (3, 4, 5)
union all select distinct user_id, '', 0, case user_id % 10 when 4 then 'too large' else 'no state' end from events where user_id % 10 in (3, 4, 5)""",
    "element_positions": f"""with {drawn.NODES_SQL},
s as (select c, k, kind || ':' || case when k = 0 then 0 else row_number() over (partition by c, k & (k - 1), k = 0, kind order by k) - 1 end as part from d),
w as (select c, ak, bk, row_number() over (partition by c, bk order by ak desc) as up from (select c, ak, bk from u union all select c, k, k from d))
select w.c as capture_id, w.bk as node, string_agg(s.part, '/' order by up) as position from w join s on s.c = w.c and s.k = w.ak where up <= 5 group by all""",
    "rebound_links": """
with l as (select page_id, unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) as name, unnest(range(1, len(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>')) + 1)) as at from pages),
m as (select *, trim(name) as n from l)
select a.page_id, a.at as ref, (select count(*) from m b where b.page_id = a.page_id and b.n = a.n) + (a.n = 'new')::bigint as matches,
 case when (select count(*) from m b where b.page_id = a.page_id and b.n = a.n) = 1 and a.n <> 'new' then a.at when (select b.n from m b where b.page_id = a.page_id and b.at = a.at - 1) = a.n then a.at - 1 end as bound from m a""",
    "stream_numbers_until_idle": """
with e as (select user_id::varchar as s, event_type as kind, (props ->> '$.k')::bigint % 10 as backend, ts, event_id, case when lag(ts) over w is null or epoch_ms(ts) - epoch_ms(lag(ts) over w) > 6 * 3600 * 1000 then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(new) over (partition by s order by ts, event_id) - 1 as epoch from e),
f as (select s, epoch, kind, backend, min(struct_pack(ts := ts, id := event_id)) as first from g group by all)
select s as session_id, epoch::bigint as epoch, kind, backend, row_number() over (partition by s, epoch, kind order by first) as number from f""",
    "stream_in_force": """
with e as (select user_id::varchar as s, event_id, ts, 'd' || (props ->> '$.k')::bigint % 3 as document, case event_type when 'view' then 'navigate' when 'error' then 'console-error' when 'click' then 'dialog' else event_type end as kind, 'k' || (props ->> '$.k') as text from events),
n as (select *, last_value(case when kind = 'navigate' then document end ignore nulls) over (partition by s order by ts, event_id) as shown from e)
select s as session_id, event_id as seq, document, kind, case when shown <> document and kind = 'dialog' then 'on the previous page: ' || text else text end as text from n where kind <> 'navigate' and not (coalesce(shown <> document, false) and kind in ('console-error', 'failed-fetch', 'toast'))""",
    "stream_outermost_toasts": """
with recursive e as (select user_id::varchar as s, event_id as id, row_number() over (partition by user_id order by ts, event_id) as i, case event_type when 'error' then 'drain' when 'click' then 'remove' else 'add' end as what, (props ->> '$.k')::bigint % 8 as n, case when (props ->> '$.k')::bigint % 8 >= 4 then (props ->> '$.k')::bigint % 8 - 4 else -1 end as p, case when (props ->> '$.k')::bigint % 5 = 0 then '' else 't' || (props ->> '$.k')::bigint % 4 end as t from events),
r as (select s, 0::bigint as i, -1::bigint as id, []::struct(n bigint, p bigint, t varchar)[] as c, []::varchar[] as told, []::varchar[] as fresh from (select distinct s from e)
 union all select r.s, e.i, e.id,
  case e.what when 'add' then case when len(list_filter(r.c, lambda x: x.n = e.n or x.n = e.p)) > 0 then r.c else list_append(r.c, struct_pack(n := e.n, p := e.p, t := e.t)) end when 'remove' then list_filter(r.c, lambda x: x.n <> e.n and x.p <> e.n) else [] end,
  case e.what when 'drain' then [] when 'remove' then list_distinct(list_concat(r.told, list_transform(list_filter(r.c, lambda x: x.n = e.n or x.p = e.n), lambda x: x.t))) else r.told end,
  case e.what when 'remove' then list_filter(list_distinct(list_transform(list_filter(r.c, lambda x: x.n = e.n or x.p = e.n), lambda x: x.t)), lambda t: t <> '' and not list_contains(r.told, t)) else [] end
 from r join e on e.s = r.s and e.i = r.i + 1)
select s as session_id, id as seq, unnest(fresh) as text from r""",
    "stream_ended_sessions": """
with recursive k as (select user_id::varchar as s, event_id, ts::timestamp as ts, (props ->> '$.k')::bigint as k, event_type as t from events),
e as (select s, row_number() over (partition by s order by ts, event_id) as i, ts, case when t = 'view' then 'hold' when t = 'click' then 'release' when t = 'purchase' then 'start' when t <> 'error' then 'done' when k % 3 = 0 then 'stop' when k % 3 = 1 then 'done' else 'use' end as what, case when t in ('view', 'click') then 'h' || k % 2 else 'r' end as who from k),
r as (select s, 0::bigint as i, null::timestamp as o, null::timestamp as u, null::timestamp as rel, []::varchar[] as h, []::varchar[] as q, null::timestamp as due, null::timestamp as bo, null::timestamp as bt, null::varchar as bwhy, null::timestamp as so, null::timestamp as st, null::boolean as sq from (select distinct s from e)
 union all select s, i, o3, u3, rel3, h3, q3, case when o3 is null or len(h3) + len(q3) > 0 then null when rel3 is null then u3 + interval '12 hours' else greatest(u3, rel3 + interval '2 hours') end,
  case when over then o end, case when over then due end, case when over then case when rel is null then 'idle' else 'holder left' end end, case when what = 'stop' then o1 end, case when what = 'stop' and o1 is not null then ts end, len(q1) > 0
 from (select *, case when what = 'stop' then null when odd then o1 else coalesce(o1, ts) end as o3, case when what = 'stop' then null when odd then u1 when what in ('hold', 'release') then coalesce(u1, ts) else ts end as u3,
   case when what in ('stop', 'hold') then null when what = 'release' and not odd then case when len(h3) = 0 then ts end else rel1 end as rel3
  from (select *, what = 'release' and not list_contains(h1, who) or what = 'done' and not list_contains(q1, who) as odd,
    case what when 'stop' then [] when 'hold' then list_distinct(list_append(h1, who)) when 'release' then list_filter(h1, lambda x: x <> who) else h1 end as h3, case what when 'stop' then [] when 'start' then list_distinct(list_append(q1, who)) when 'done' then list_filter(q1, lambda x: x <> who) else q1 end as q3
   from (select r.s, e.i, e.ts, e.what, e.who, r.o, r.rel, r.due, coalesce(r.due <= e.ts, false) as over, case when over then null else r.o end as o1, case when over then null else r.u end as u1, case when over then null else r.rel end as rel1, case when over then [] else r.h end as h1, case when over then [] else r.q end as q1 from r join e on e.s = r.s and e.i = r.i + 1)))),
z as (select *, row_number() over (partition by s order by i desc) as back from r)
select s as session_id, bo as opened, bt as ended, bwhy as why, false as busy from r where bt is not null
union all select s, so, st, 'stopped', sq from r where st is not null
union all select s, o, due, case when rel is null then 'idle' else 'holder left' end, false from z where back = 1 and due is not null""",
}
