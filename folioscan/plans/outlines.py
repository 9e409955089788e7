"""Registered queries on outlines: entries of repeated siblings, lines within a budget."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscan.operators import entries, facts
from folioscan.sources.markup import nodes
from folioscan.sources.stored import stored

BUDGET = 100


def card_entries(spark, sf_dir):
    """Each order as a page: an anonymous section with a heading if its number is even, then a
    card for each line item, a link and, unless the quantity is a multiple of 3, a text."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    cards = li.select(F.col("l_orderkey").alias("page_id"), (i * 10).alias("at"), (F.col("l_quantity").cast("long") % 3 != 0).alias("two"))
    row = lambda node, parent, sort, head, kind: F.struct(node.cast("int").alias("node"), parent.cast("int").alias("parent"), F.lit(sort).alias("sort"), F.lit(head).alias("head"), F.lit(kind).alias("kind"), F.lit("").alias("name"))
    at, zero = F.col("at"), F.lit(0)
    parts = F.array(row(at, zero, "box", "", ""), row(at + 1, at, "leaf", "link", "a"))
    cards = cards.select("page_id", F.inline(F.when(F.col("two"), F.concat(parts, F.array(row(at + 2, at, "text", "text", "")))).otherwise(parts)))
    tops = li.select(F.col("l_orderkey").alias("page_id")).distinct()
    root = F.array(row(zero, F.lit(None), "box", "", ""))
    tops = tops.select("page_id", F.inline(F.when(F.col("page_id") % 2 == 0, F.concat(root, F.array(row(F.lit(1), zero, "leaf", "heading", "")))).otherwise(root)))
    out = entries.arrange(cards.unionByName(tops))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return out.select("page_id", whole("pos"), whole("up"), whole("indent"), whole("node"), "head", "kind", whole("run"), whole("repeat"), "flat")


def _outline(spark, sf_dir):
    f = stored(facts.facts(nodes(spark.read.parquet(f"{sf_dir}/pages.parquet"))), "facts")
    tree = stored(entries.arrange(entries.items(f)), "entries")
    return stored(entries.outline_lines(tree), "outline")


def page_outline_lines(spark, sf_dir):
    """What the outline of each page holds: the collapsed navigation, headings, paragraphs."""
    lines = _outline(spark, sf_dir)
    kind = lambda start: F.count_if(F.trim("line").startswith(start))
    return lines.groupBy("page_id").agg(F.max(F.regexp_extract("line", r"^\s*nav r\d+ collapsed (\d+) links$", 1)).alias("nav_links"), kind("heading").alias("headings"), kind("text").alias("texts"), kind("footer").alias("footers"), F.max("indent").cast("long").alias("deepest"))


def outline_ratios(spark, sf_dir):
    """Characters of outlines, whole and within a quarter and an eighth of the default budget."""
    lines = _outline(spark, sf_dir)
    whole = lines.groupBy("page_id").agg(F.sum(F.char_length("line") + 1).alias("whole"))
    rows = entries.turns(lines)
    for name, tokens in (("fitted", 60), ("tight", 30)):
        kept = entries.fit_turns(rows, tokens).groupBy("page_id").agg(F.sum(F.char_length("line") + 1).alias(name), F.count_if(F.col("what") == "marker").alias(f"{name}_markers"))
        whole = whole.join(kept, "page_id", "left")
    return whole


def document_lines(spark, sf_dir):
    """Lines of documents as outlines: every fifth encloses the next four, some have refs. Marks
    that open emphasis, links and code stand for other signs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    rows = docs.select("doc_id", F.posexplode(F.split(F.translate("text", "*[~`", "+(-'"), "\n")).alias("pos", "line"))
    n, pos = F.char_length("line"), F.col("pos")
    return rows.select("doc_id", "pos", F.when(pos % 5 == 0, -1).otherwise(pos - pos % 5).alias("up"), (pos % 5 != 0).cast("int").alias("indent"), (pos + 1000).alias("node"), (3 + n % 4).cast("int").alias("class"), (n % 3 != 0).cast("int").alias("rank"), F.when(pos % 10 == 0, F.concat(F.lit("r"), (F.floor(pos / 10) + 1).cast("string"))).otherwise("").alias("ref"), "line")


def budgeted_lines(spark, sf_dir):
    """Documents within 100 tokens: kept lines, markers of dropped ones, the cut of a line that is
    longer than the whole budget."""
    out = entries.fit(document_lines(spark, sf_dir), BUDGET, ("doc_id",))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "what", "ref", F.coalesce(F.col("opens"), F.lit(-1)).cast("long").alias("opens"), "line")


def budget_use(spark, sf_dir):
    """What of each document the budget keeps."""
    rows = document_lines(spark, sf_dir)
    whole = rows.groupBy("doc_id").agg(F.sum(F.char_length("line") + 1).alias("chars"))
    kept = entries.fit(rows, BUDGET, ("doc_id",)).groupBy("doc_id").agg(F.sum(F.char_length("line") + 1).alias("kept_chars"))
    return whole.join(kept, "doc_id").select("doc_id", "chars", "kept_chars", (F.col("kept_chars") <= 4 * BUDGET).alias("holds"))


QUERIES = {f.__name__: f for f in (card_entries, page_outline_lines, outline_ratios, budgeted_lines, budget_use)}

_CARDS = """
with c as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as i, l_quantity::bigint % 3 <> 0 as two from lineitem),
g as (select *, i - row_number() over (partition by o, two order by i) as g from c),
r as (select o, two as run_two, min(i) as lo, count(*) as n from g group by o, two, g having count(*) >= 3 qualify row_number() over (partition by o order by count(*) desc, min(i)) = 1),
s as (select c.*, coalesce(i between lo and lo + n - 1, false) as inside, lo, n, run_two, count(*) over (partition by c.o) as m from c left join r using (o)),
x as (
 select o, 1 as node, 'heading' as head, '' as kind, 0 as indent, -1 as run, 0 as repeat, false as flat, 0 as k, null::bigint as up_node from (select distinct o from c) where o % 2 = 0
 union all select o, 0, 'list', case when run_two then 'r' else '' end, 0, -1, n, false, lo * 10 - 1, null from s where i = lo
 union all select o, i * 10, 'item', '', 1, i - lo, 0, true, i * 10, 0 from s where inside and two
 union all select o, i * 10 + 1, 'link', 'a', case when not inside then 0 when two then 2 else 1 end, case when inside and not two then i - lo else -1 end, 0, false, i * 10 + 1, case when not inside then null when two then i * 10 else 0 end from s
 union all select o, i * 10 + 2, 'text', '', case when inside then 2 else 0 end, -1, 0, false, i * 10 + 2, case when inside then i * 10 end from s where two),
y as (select *, row_number() over (partition by o order by k) - 1 as pos from x)
select y.o as page_id, y.pos, coalesce(u.pos, -1) as up, y.indent::bigint as indent, y.node::bigint as node, y.head, y.kind, y.run::bigint as run, y.repeat::bigint as repeat, y.flat from y left join y u on u.o = y.o and u.node = y.up_node and u.head in ('list', 'item')"""

LINES_SQL = """
with l as (select doc_id, unnest(string_split(translate(text, '*[~`', '+(-'''), chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
a as (select *, case when pos % 5 = 0 then -1 else pos - pos % 5 end as up, (pos % 5 <> 0)::int as indent, 3 + length(line) % 4 as class, (length(line) % 3 <> 0)::int as rank, case when pos % 10 = 0 then 'r' || (pos // 10 + 1) else '' end as ref from l)"""

_FIT = f"""{LINES_SQL},
k as (select *, [class, rank, pos] as own from a),
e as (select k.*, case when up >= 0 then own else least(own, (select min(b.own) from k b where b.doc_id = k.doc_id and b.up = k.pos)) end as key from k),
t as (select *, row_number() over (partition by doc_id order by key, pos) as turn, count(*) over (partition by doc_id) as total, length(line) + 1 as width, max(length(ref)) over (partition by doc_id) as lr from e),
w as (select *, greatest(lr, 1 + length((2 * total + 1)::varchar)) as rw, 2 * indent + 14 + length((2 * total + 1)::varchar) + greatest(lr, 1 + length((2 * total + 1)::varchar)) + 1 as gap from t),
n as (select w.*, n.n, turn <= n.n as kept from w join (select doc_id, unnest(range(0, max(total) + 1)) as n from w group by 1) n using (doc_id)),
p as (select *, coalesce(lag(kept) over (partition by doc_id, n order by pos), true) as before from n),
c as (select doc_id, n, sum(case when kept then width when before then gap else 0 end) as cost from p group by all),
z as (select doc_id, max(n) filter (cost <= {4 * BUDGET}) as most from c group by 1),
q as (select w.*, most, turn <= most as keep, {4 * BUDGET} - (c.cost - width)::bigint - 2 - rw - 1 as room from w join z using (doc_id) left join c on c.doc_id = w.doc_id and c.n = most + 1 where most is not null),
u as (select *, case when turn = most + 1 and width > {4 * BUDGET} and room >= 24 then case when substr(line, room + 1, 1) = ' ' then rtrim(substr(line, 1, room)) when position(' ' in trim(substr(line, 1, room))) > 0 then rtrim(regexp_extract(substr(line, 1, room), '^(.*) ', 1)) else substr(line, 1, room) end end as cut0 from q),
v as (select *, case when length(cut0) >= 24 then cut0 end as cut from u),
s as (select *, keep or cut is not null as stays, sum((keep or cut is not null)::int) over (partition by doc_id order by pos) as island, count(*) filter (ref <> '') over (partition by doc_id) + max((cut is not null and ref = '')::int) over (partition by doc_id) as used from v),
d as (select doc_id, island, min(pos) as pos, count(*) as m from s where not stays group by all),
f as (select d.doc_id, d.pos, d.m, s.indent, s.up, s.used, coalesce(nullif(h.ref, ''), nullif(s.ref, '')) as given, coalesce(h.pos, s.pos) + 1000 as opens from d join s using (doc_id, pos) left join s h on h.doc_id = d.doc_id and h.pos = s.up and h.stays),
m as (select *, coalesce(given, 'r' || (used + sum((given is null)::int) over (partition by doc_id order by pos))) as ref from f),
o as (select doc_id, pos, case when keep then 'line' else 'cut' end as what, case when keep then ref else coalesce(nullif(ref, ''), 'r' || used) end as ref, case when not keep and ref = '' then pos + 1000 else -1 end as opens, case when keep then line else cut || '… ' || coalesce(nullif(ref, ''), 'r' || used) end as line from s where stays
 union all select doc_id, pos, 'marker', ref, case when given is null then opens else -1 end, repeat('  ', indent) || '… ' || m || case when m = 1 then ' more line ' else ' more lines ' end || ref from m)"""

ORACLE_SQL = {
    "card_entries": _CARDS,
    "page_outline_lines": r"""
with p as (select page_id, regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>', '', 'g') as h from pages)
select page_id, len(regexp_extract_all(regexp_extract(h, '(?s)<nav>.*?</nav>'), '<a '))::varchar as nav_links, len(list_filter(regexp_extract_all(h, '(?s)<h1>([^<]*)</h1>', 1), lambda x: trim(x) <> ''))::bigint as headings,
 (len(list_filter(regexp_extract_all(h, '(?s)<p>([^<]*)', 1), lambda x: trim(x) <> '')) + len(regexp_extract_all(h, '<p><b>[^<]*[^< ]')) + len(regexp_extract_all(h, '<div class="ad">[^<]*[^< ]')))::bigint as texts,
 len(regexp_extract_all(h, '<footer>'))::bigint as footers, 1::bigint as deepest from p""",
    "budgeted_lines": f"{_FIT} select doc_id, pos::bigint as pos, what, ref, opens::bigint as opens, line from o",
    "budget_use": f"{_FIT} select doc_id, chars::bigint as chars, kept_chars::bigint as kept_chars, kept_chars <= {4 * BUDGET} as holds from (select doc_id, sum(length(line) + 1) as chars from l group by 1) join (select doc_id, sum(length(line) + 1) as kept_chars from o group by 1) using (doc_id)",
}
