"""Registered queries on captures with layout, made from pages on Spark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscan.operators import controls, geometry
from folioscan.sources import captures
from folioscan.sources.markup import nodes


def _boxes(spark, sf_dir):
    """Element rows of pages with boxes dealt by arithmetic on node and page."""
    n = nodes(spark.read.parquet(f"{sf_dir}/pages.parquet")).where("kind = 'element' and tag in ('nav', 'ul', 'li', 'a', 'div', 'article', 'h1', 'p', 'b', 'footer')").withColumnRenamed("page_id", "capture_id")
    k = F.col("node")
    x = F.when(F.col("tag").isin("li", "footer"), 0.0).when(F.col("tag") == "a", 110.0).otherwise(((k * 37) % 5 * 120).cast("double"))
    y = F.when(F.col("tag") == "li", k * 20.0).when(F.col("tag") == "a", k * 20.0 - 20).when(F.col("tag") == "footer", 100.0).otherwise((F.floor(k / 3) * 20 + (k * 7) % 9).cast("double"))
    wide = F.col("tag") == "footer"
    box = F.struct(x.alias("x"), y.alias("y"), F.when(wide, 900.0).otherwise(100.0).alias("w"), F.when(wide, 300.0).when(F.col("tag").isin("li", "a"), 16.0).otherwise((16 + (k * 5) % 7).cast("double")).alias("h"))
    return n.select("capture_id", "node", F.coalesce("parent", F.lit(-1)).alias("parent"), "end", "path", "tag", box.alias("box"), k.alias("paint"), (F.col("tag") == "footer").alias("paints"))


def reading_order(spark, sf_dir):
    rows = _boxes(spark, sf_dir).where("tag = 'p'").withColumn("parent", F.lit(0))
    return geometry.reading_order(rows).groupBy("capture_id").agg(F.max("row").cast("long").alias("last_row"), F.sum(F.col("row") * (F.col("pos") + 1)).cast("long").alias("check"))


def offscreen_boxes(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    caps = b.select("capture_id").distinct().select("capture_id", F.lit(400.0).alias("content_w"), F.lit(300.0).alias("content_h"))
    return geometry.offscreen(b, caps).groupBy("capture_id").agg(F.count_if("offscreen").alias("offscreen"))


def occlusion(spark, sf_dir):
    return geometry.occluded(_boxes(spark, sf_dir)).groupBy("capture_id").agg(F.count("*").alias("covered"), F.sum("coverer").cast("long").alias("coverers"))


def _items(spark, sf_dir):
    """Line items of an order as boxes of one capture, numbered from 0."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("capture_id"), n.alias("node"))


def _box(x, y, w, h):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def reading_rows(spark, sf_dir):
    n = F.col("node")
    b = _items(spark, sf_dir).select("capture_id", F.lit(0).alias("parent"), (100 - n).alias("node"), n.alias("k"), _box((n % 2) * 100, F.floor(n / 2) * 130 + (n % 2) * F.lit(14), F.lit(90), F.when(n % 2 == 0, 100).otherwise(F.when(F.col("capture_id") % 2 == 0, 20).otherwise(40))).alias("box"))
    return geometry.reading_order(b).select("capture_id", "k", F.col("row").cast("long").alias("row"), F.col("pos").cast("long").alias("pos"))


def offscreen_items(spark, sf_dir):
    b = _items(spark, sf_dir).select("capture_id", "node", _box(F.col("node") * 100 - 150, F.lit(0), F.lit(100), F.lit(20)).alias("box"))
    caps = b.select("capture_id").distinct().select("capture_id", F.lit(400.0).alias("content_w"), F.lit(300.0).alias("content_h"))
    return geometry.offscreen(b, caps).select("capture_id", F.col("node").cast("long").alias("node"), "offscreen")


def covered_items(spark, sf_dir):
    """A cover over the first boxes of each capture, as wide as its number says, a huge one now
    and then, and covers over the middle of the later boxes that leave their corners open or not."""
    n, k = F.col("node"), F.col("capture_id")
    none = F.array().cast("array<int>")
    items = _items(spark, sf_dir)
    b = items.select("capture_id", "node", (n + 1).alias("end"), none.alias("path"), n.alias("paint"), F.lit(False).alias("paints"), _box(n * 50, F.lit(0), F.lit(40), F.lit(40)).alias("box"))
    wide = F.when(k % 10 == 0, 1e9).otherwise(k % 5 * 50)
    middle = items.select("capture_id", (n + 2000).alias("node"), (n + 2001).alias("end"), none.alias("path"), F.lit(400).alias("paint"), F.lit(True).alias("paints"), _box(n * 50 + F.when(k % 2 == 0, 2).otherwise(1), F.lit(1), F.when(k % 2 == 0, 36).otherwise(39), F.lit(39)).alias("box")).where("node >= 2005")
    covers = items.select("capture_id").distinct().select("capture_id", F.lit(1000).alias("node"), F.lit(1001).alias("end"), none.alias("path"), F.lit(500).alias("paint"), F.lit(True).alias("paints"), _box(F.lit(-1), F.lit(-1), wide + 1, F.lit(1e9)).alias("box"))
    return geometry.occluded(b.unionByName(covers).unionByName(middle)).where("node < 1000").select("capture_id", F.col("node").cast("long").alias("node"), F.col("coverer").cast("long").alias("coverer"))


def scrolling_boxes(spark, sf_dir):
    n, k = F.col("node"), F.col("capture_id")
    style = F.struct(F.when(n % 2 == 0, "auto").otherwise("visible").alias("overflow_x"), F.when(k % 3 == 0, "scroll").otherwise("hidden").alias("overflow_y"), F.when(k % 4 == 0, "ellipsis").otherwise("clip").alias("text_overflow"), F.when(n % 3 == 0, "2").otherwise("none").alias("line_clamp"))
    b = _items(spark, sf_dir).select("capture_id", "node", F.when(n == 6, "body").otherwise("div").alias("tag"), style.alias("style"), _box(F.lit(0), F.lit(0), F.lit(100), F.lit(20)).alias("box"), _box(F.lit(0), F.lit(0), 98 + k % 7, 18 + n).alias("scroll"))
    return b.select("capture_id", n.cast("long").alias("node"), geometry.scrollable(b).alias("scrollable"), geometry.truncated(b).alias("truncated"))


def struck_texts(spark, sf_dir):
    """Chains of boxes: the first is struck through, some below take no decoration from outside."""
    n, k = F.col("node"), F.col("capture_id")
    style = F.struct(F.when(n == 0, "line-through").otherwise("none").alias("text_decoration"), F.when((n > 0) & (n == k % 5), "absolute").otherwise("static").alias("position"), F.lit("none").alias("float"), F.lit("block").alias("display"))
    path = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = _items(spark, sf_dir).select("capture_id", "node", path.alias("path"), style.alias("style"))
    return controls.struck(rows).select("capture_id", F.col("node").cast("long").alias("node"), "struck")


def heading_blocks(spark, sf_dir):
    """Blocks that look like headings, inside one another and inside controls."""
    n, k = F.col("node"), F.col("capture_id")
    size = F.when(n % 2 == 0, 34.0).otherwise(16.0)
    b = _items(spark, sf_dir).select("capture_id", n.cast("int").alias("node"), F.when(n == 2, 4).otherwise(n + 1).alias("end"), size.alias("size"), F.lit(False).alias("bold"), F.when(k % 9 == 0, 200).otherwise(12).alias("chars"), F.lit("").alias("role"), (n == 4).alias("interactive"), F.lit(False).alias("heading"), (k % 4 == 0).alias("hidden"))
    m = b.select("capture_id").distinct().withColumn("size", F.lit(16.0))
    return geometry.visual_headings(b, m).select("capture_id", F.col("node").cast("long").alias("node"), F.col("level").cast("long").alias("level"))


def _texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.element_at(F.array(*[F.lit(float(x)) for x in (12, 16, 16, 20, 32)]), (F.col("doc_id") % 5 + 1).cast("int"))
    shade = F.element_at(F.array(*[F.lit(x) for x in ("#000000", "#cc0000", "#118822", "#888888", "#000000")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select((F.col("doc_id") % 50).alias("capture_id"), "doc_id", size.alias("size"), shade.alias("colour"), F.char_length("text").alias("weight"))


def font_baseline(spark, sf_dir):
    t = _texts(spark, sf_dir)
    return geometry.median_size(t).join(geometry.dominant_colour(t), "capture_id")


def visual_headings(spark, sf_dir):
    t = _texts(spark, sf_dir)
    m = geometry.median_size(t).withColumnRenamed("size", "median")
    level = geometry.heading_level(F.col("size"), F.col("median"), F.col("doc_id") % 2 == 0, F.col("weight") % 200)
    return t.join(m, "capture_id").select("doc_id", level.cast("long").alias("level"))


def decoded_captures(spark, sf_dir):
    """Pages as dictionary-encoded captures, decoded again: title node and two children."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    doc = F.concat(F.lit('{"documents":[{"documentURL":0,"nodes":{"parentIndex":[-1,0,1,0,9],"nodeType":[9,1,3,1,3],"nodeName":[2,3,4,5,4],"nodeValue":[-1,-1,0,-1,99],"backendNodeId":[1,2,3],"attributes":[[],[6,0,6,2],[],[7]],"isClickable":{"index":[1]},"inputValue":{"index":[3],"value":[0]}},"layout":{"nodeIndex":[1,4],"bounds":[[1,2,3,4],[5,6,7,8]],"text":[-1,0],"paintOrders":[7]}}],"strings":['), F.to_json(F.struct("url")).substr(F.lit(8), F.length(F.to_json(F.struct("url"))) - 8), F.lit(',"#d","#document","A","#text","INPUT","HREF","x"]}'))
    raw = pages.select(F.col("page_id").alias("capture_id"), F.when(F.col("page_id") % 10 == 9, '{"documents":[]}').otherwise(doc).alias("capture"))
    out, rejected = captures.decode(raw)
    rows = out.select("capture_id", F.col("node").cast("long").alias("node"), F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), "kind", "tag", "text", F.coalesce(F.col("attrs")["HREF"], F.lit("")).alias("href"), "clickable", "value", F.col("box.h").alias("h"), F.col("paint").cast("long").alias("paint"))
    bad = rejected.select("capture_id", F.lit(-1).cast("long").alias("node"), F.lit(-1).cast("long").alias("parent"), F.col("reason").alias("kind"), *[F.lit("").alias(c) for c in ("tag", "text", "href")], F.lit(False).alias("clickable"), F.lit("").alias("value"), F.lit(0.0).alias("h"), F.lit(0).cast("long").alias("paint"))
    return rows.unionByName(bad)


QUERIES = {f.__name__: f for f in (reading_order, offscreen_boxes, occlusion, font_baseline, visual_headings, decoded_captures, reading_rows, offscreen_items, covered_items, scrolling_boxes, struck_texts, heading_blocks)}

_T = """t as (select doc_id % 50 as capture_id, doc_id, [12.0, 16.0, 16.0, 20.0, 32.0][doc_id % 5 + 1]::double as size, ['#000000', '#cc0000', '#118822', '#888888', '#000000'][doc_id % 5 + 1] as colour, length(text) as weight from documents),
s as (select capture_id, size, sum(weight) as w from t group by all), u as (select *, sum(w) over (partition by capture_id order by size) as upto, sum(w) over (partition by capture_id) as total from s),
m as (select capture_id, min(size) as median from u where 2 * upto >= total group by 1),
b as (select capture_id, colour as base from (select capture_id, colour, sum(weight) as w from t group by all) qualify row_number() over (partition by capture_id order by w desc, colour) = 1)"""

_ITEMS = "i as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as n from lineitem)"

ORACLE_SQL = {
    "reading_rows": f"with {_ITEMS} select k as capture_id, n as k, case when k % 2 = 0 then n else n // 2 end as row, n as pos from i",
    "offscreen_items": f"with {_ITEMS} select k as capture_id, n as node, n = 0 or n >= 6 as offscreen from i",
    "covered_items": f"with {_ITEMS} select k as capture_id, n as node, case when k % 10 = 0 or n < k % 5 then 1000 else 2000 + n end::bigint as coverer from i where k % 10 = 0 or n < k % 5 or (n >= 5 and k % 2 = 1)",
    "scrolling_boxes": f"with {_ITEMS} select k as capture_id, n as node, n <> 6 and (k % 3 = 0 and 18 + n > 21 or n % 2 = 0 and 98 + k % 7 > 101) as scrollable, k % 4 = 0 and 98 + k % 7 > 101 or n % 3 = 0 and 18 + n > 21 as truncated from i",
    "struck_texts": f"with {_ITEMS} select k as capture_id, n as node, n = 0 or k % 5 = 0 or n < k % 5 as struck from i",
    "heading_blocks": f"with {_ITEMS} select k as capture_id, n as node, 1::bigint as level from i where n % 2 = 0 and n <> 4 and k % 9 <> 0 and k % 4 <> 0",
    "font_baseline": f"with {_T} select capture_id, median as size, base as colour from m join b using (capture_id)",
    "visual_headings": f"with {_T} select doc_id, case when weight % 200 > 140 then null when size / median >= 2 then 1 when size / median >= 1.6 then 2 when size / median >= 1.3 then 3 when size / median >= 1.15 and doc_id % 2 = 0 then 4 end::bigint as level from t join m using (capture_id)",
    "decoded_captures": """
with p as (select page_id as capture_id, url from pages where page_id % 10 <> 9)
select capture_id, 0::bigint as node, -1::bigint as parent, 'document' as kind, '' as tag, '' as text, '' as href, false as clickable, '' as value, 0.0::double as h, 0::bigint as paint from p
union all select capture_id, 1, 0, 'element', 'a', '', url, true, '', 4.0, 7 from p
union all select capture_id, 2, 1, 'text', '', url, '', false, '', 0.0, 0 from p
union all select capture_id, 3, 0, 'element', 'input', '', '', false, url, 0.0, 0 from p
union all select capture_id, 4, -1, 'text', '', url, '', false, '', 8.0, 0 from p
union all select page_id, -1, -1, 'no documents', '', '', '', false, '', 0.0, 0 from pages where page_id % 10 = 9""",
}
