"""Registered queries on targets and phrases: each page of the table yields a page of its own
number, on which every way of answering to a name occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import facts, targets, views
from folioscan.sources.markup import nodes
from folioscan.sources.stored import stored

PAGE = (
    "<body><button id=save>Save {id}</button><button id=late hidden>Later {id}</button><div id=pane role=region aria-label='Pane {id}' style='overflow-y: auto'>long</div>"
    "<button id=o1>Open</button><button id=o2>Open</button><div id=wrap onclick=x()><button id=pick>Pick {id}</button></div>"
    "<p id=said>All <b>shown</b>\n words <a href=/{id}>of {id}</a></p><p id=odd>{odd}twice said</p><p id=even>twice said</p>"
    "<iframe title='Pay frame {id}'></iframe><button id=star aria-label='Secret {id}'>Star</button>"
    "<button id=under data-under=1>Twice</button><button id=over>Twice</button></body>"
)
ASKED = ("SAVE  {id}", "later {id}", "pane {id}", "open", "pick {id}", "all shown words of {id}", "twice said", "y frame {id}", "secret {id}", "star", "twice", "av", "nothing {id}", "")
PHRASES = ("shown words of {id}", "twice said", "save {id}", "words of", "n w", "{id}")


def _pages(spark, sf_dir):
    k = F.col("page_id")
    odd = F.when(k % 2 == 1, "not ").otherwise("")
    html = F.replace(F.replace(F.lit(PAGE), F.lit("{id}"), k.cast("string")), F.lit("{odd}"), odd)
    f = facts.facts(nodes(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.alias("html"))))
    return stored(f.withColumn("id", F.col("attrs")["id"]), "targets")


def named_targets(spark, sf_dir):
    f = _pages(spark, sf_dir)
    each = F.posexplode(F.array(*[F.lit(a) for a in ASKED])).alias("k", "text")
    asked = f.select("page_id").distinct().select("page_id", each).select("page_id", "k", F.concat_ws("/", "page_id", "k").alias("query_id"), F.replace("text", F.lit("{id}"), F.col("page_id").cast("string")).alias("text"))
    frames = f.where("tag = 'iframe'").select("page_id", F.col("attrs")["title"].alias("label"))
    named = stored(targets.candidates(f, F.col("attrs")["data-under"].isNotNull()), "named")
    out = targets.resolve(asked, named, targets.shown_words(asked, f), frames)
    ids = f.where("id is not null").select("page_id", "node", "id")
    return out.join(ids, ["page_id", "node"], "left").select("page_id", F.col("k").cast("long").alias("k"), "outcome", "way", F.coalesce("id", F.lit("")).alias("id"), F.col("matches").cast("long").alias("matches"))


def split_phrases(spark, sf_dir):
    """Phrases over several inline texts, found once, on their paragraph."""
    f = _pages(spark, sf_dir)
    terms = f.select("page_id").distinct().select(F.explode(F.array(*[F.replace(F.lit(p), F.lit("{id}"), F.concat(F.lit(""), F.col("page_id").cast("string"))) for p in PHRASES])).alias("term")).distinct()
    found = views.search_phrases(f, terms)
    return found.join(f.select("page_id", "node", "id"), ["page_id", "node"]).select("page_id", "term", "id")


QUERIES = {f.__name__: f for f in (named_targets, split_phrases)}

_OUT = ["'found', 'control', 'save', 1", "'found', 'hidden', 'late', 1", "'found', 'scroller', 'pane', 1", "'ambiguous', 'ambiguous', '', 2", "'found', 'control', 'pick', 1", "'found', 'words', 'said', 1", None, "'in frame', '', '', 0", "'labelled otherwise', '', 'star', 0", "'found', 'control', 'star', 1", "'found', 'control', 'over', 1", "'near', '', '', 1", "'not found', '', '', 0", "'not found', '', '', 0"]
_CASE = "case when page_id % 2 = 1 then 'found' else 'not found' end, case when page_id % 2 = 1 then 'words' else '' end, case when page_id % 2 = 1 then 'even' else '' end, (page_id % 2)"

ORACLE_SQL = {
    "named_targets": "select page_id, k::bigint as k, outcome, way, id, matches::bigint as matches from (" + " union all ".join(f"select page_id, {k}, {o or _CASE} from pages" for k, o in enumerate(_OUT)) + ") t(page_id, k, outcome, way, id, matches)",
    "split_phrases": "with p as (select page_id from pages) select page_id, 'shown words of ' || page_id as term, 'said' as id from p union all select page_id, 'words of', 'said' from p union all select page_id, 'n w', 'said' from p"
    " union all select b.page_id, 'shown words of ' || a.page_id, 'said' from p a join p b on a.page_id <> b.page_id and starts_with(b.page_id::varchar, a.page_id::varchar)",
}
