"""What a name or a text on a page stands for: the control, region or words it means, or why
nothing answers to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.operators import facts, tree
from folioscan.sources.stored import stored

# The ways in which something answers, in the order they are tried.
WAYS = ("control", "scroller", "hidden", "words")


def _letters(s: Column) -> list[Column]:
    """Counts of a text that add up over its parts: characters other than blanks, the sum of
    their code points and of the squares of these."""
    points = F.transform(F.filter(F.split(s, ""), lambda c: F.trim(c) != ""), lambda c: F.ascii(c).cast("long"))
    add = lambda f: F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + f(x))
    return [add(lambda x: F.lit(1)).alias("n"), add(lambda x: x).alias("s"), add(lambda x: x * x).alias("q")]


def candidates(facts_df: DataFrame, covered: Column | None = None) -> DataFrame:
    """(page_id, node, end, name, label, acts, visible, covered, scrolls) of what a name can
    mean. ``name`` is what a person reads: the words shown where the label says otherwise, the
    label then in ``label``; a hidden control is named by its aria-label or its own words."""
    pieces = facts.readable(facts_df)
    said = stored(facts.names(facts_df, pieces), "names")
    labelled = said.where("source in ('labelledby', 'aria-label')").join(facts_df.where("interactive").select("page_id", "node"), ["page_id", "node"])
    read = tree.text_of(pieces, labelled.select("page_id", F.col("node").alias("root"))).select("page_id", F.col("root").alias("node"), text.clean(F.col("content")).alias("shown"))
    differs = labelled.join(read, ["page_id", "node"]).where(text.label_differs(F.col("name"), F.col("shown"))).select("page_id", "node", "shown").hint("merge")
    scrolls = F.coalesce(F.lower(facts.attr("style")).rlike(r"overflow(-[xy])?\s*:\s*(auto|scroll)"), F.lit(False))
    acting = F.col("interactive") | F.col("clickable") | (F.col("hidden") & F.col("role").isin(*facts.INTERACTIVE) & (F.col("role") != "option"))
    rows = facts_df.where(F.col("kind") == "element").withColumns({"acts": acting, "scrolls": scrolls & ~F.col("hidden"), "covered": F.lit(False) if covered is None else F.coalesce(covered, F.lit(False))}).where("acts or scrolls")
    unseen = rows.where("hidden or role = ''").select("page_id", F.col("node").alias("root"))
    words = facts_df.where("kind = 'text'").withColumn("piece", F.concat(F.lit(" "), "text"))
    own = tree.text_of(words, unseen).select("page_id", F.col("root").alias("node"), text.clean(F.col("content")).alias("_own"))
    out = rows.join(said, ["page_id", "node"], "left").join(differs, ["page_id", "node"], "left").join(own, ["page_id", "node"], "left")
    label = F.nullif(text.clean(F.coalesce(facts.attr("aria-label"), F.lit(""))), F.lit(""))
    name = F.when(F.col("hidden") | (F.col("role") == ""), F.coalesce(label, "_own")).otherwise(F.coalesce("shown", "name"))
    return out.select("page_id", "node", "end", F.coalesce(name, F.lit("")).alias("name"), F.when(F.col("shown").isNotNull(), F.col("name")).alias("label"), "acts", (~F.col("hidden")).alias("visible"), "covered", "scrolls")


def shown_words(asked: DataFrame, facts_df: DataFrame) -> DataFrame:
    """(query_id, page_id, node, end) of visible elements whose whole readable text is the one
    asked for, in any letter case.

    Prefix sums over the page give each subtree's letters in the counts of ``_letters``, so
    asked texts meet elements by one equality join; only those are read and compared.
    """
    pieces = facts.readable(facts_df)
    clean = F.lower(text.clean(F.col("piece")))
    counts = pieces.select("page_id", "node", *_letters(clean))
    rows = facts_df.select("page_id", "node", "end", "kind", "hidden").join(counts, ["page_id", "node"], "left")
    upto = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    keys = ("n", "s", "q")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in keys}).withColumns({f"{c}_to": F.sum(c).over(upto) for c in keys})
    ends = rows.select("page_id", F.col("node").alias("_last"), *[F.col(f"{c}_to").alias(f"{c}_last") for c in keys])
    below = rows.where("kind = 'element' and not hidden").withColumn("_last", F.col("end") - 1).join(ends.hint("merge"), ["page_id", "_last"])
    sums = below.select("page_id", "node", "end", *[(F.col(f"{c}_last") - F.col(f"{c}_to") + F.col(c)).alias(c) for c in keys])
    want = asked.select("query_id", "page_id", F.lower(text.clean(F.col("text"))).alias("_want")).where("_want <> ''")
    met = want.select("query_id", "page_id", "_want", *_letters(F.col("_want"))).join(sums, ["page_id", *keys]).drop(*keys)
    contents = tree.text_of(pieces.withColumn("path", F.concat("path", F.array("node"))), met.select("page_id", F.col("node").alias("root")).distinct())
    read = contents.select("page_id", F.col("root").alias("node"), F.lower(text.clean(F.col("content"))).alias("_read"))
    return met.join(read, ["page_id", "node"]).where("_read = _want").select("query_id", "page_id", "node", "end")


def resolve(asked: DataFrame, named: DataFrame, words: DataFrame, frames: DataFrame) -> DataFrame:
    """``asked`` (query_id, page_id, text) with (outcome, way, node, matches).

    ``named`` are ``candidates``, ``words`` the elements of ``shown_words``, ``frames``
    (page_id, label) embedded documents. Names are compared clean and in any letter case; a
    match that holds another match doesn't count. Controls that are visible and uncovered
    come first, all of that name next, several being ambiguous. Where none is named so, the
    one scroller of that name is found, else the one hidden control, else the one element of
    these words; else it is told what comes near: visible controls whose name holds the text,
    a frame whose label holds it, a control that shows other words than this label. Each way
    answers only where it finds one thing, so nothing is guessed.
    """
    q = asked.select("query_id", "page_id", F.lower(text.clean(F.col("text"))).alias("_want"))
    c = named.select("page_id", "node", "end", F.lower("name").alias("_want"), "acts", "visible", "covered", "scrolls").where("_want <> ''")
    same = q.join(c, ["page_id", "_want"])
    way = lambda name, of: of.select("query_id", "node", "end", F.lit(name).alias("way"))
    shown, both = same.where("acts and visible"), F.col("acts") & F.col("visible")
    ways = way("open control", shown.where("not covered")).unionByName(way("control", shown)).unionByName(way("scroller", same.where(F.col("scrolls") & ~both))).unionByName(way("hidden", same.where("acts and not visible"))).unionByName(way("words", words))
    following = F.lead("node").over(Window.partitionBy("query_id", "way").orderBy("node"))
    inner = ways.withColumn("_next", following).where("_next is null or _next >= end")
    counts = inner.groupBy("query_id").pivot("way", ["open control", *WAYS]).agg(F.count("node").alias("n"), F.min("node").alias("node"))
    n = lambda w: F.coalesce(F.col(f"{w}_n"), F.lit(0))
    named_so = F.when(n("open control") == 1, "open control").when((n("open control") == 0) & (n("control") == 1), "control").when(n("control") > 0, "ambiguous")
    chosen = F.coalesce(named_so, *[F.when(n(w) == 1, w) for w in WAYS[1:]])
    settled = counts.withColumn("way", chosen).where("way is not null")
    node = F.coalesce(*[F.when(F.col("way") == w, F.col(f"{w}_node")) for w in ("open control", *WAYS)])
    several = F.when(n("open control") > 0, n("open control")).otherwise(n("control"))
    settled = stored(settled.select("query_id", F.when(F.col("way") == "ambiguous", "ambiguous").otherwise("found").alias("outcome"), F.regexp_replace("way", "open ", "").alias("way"), node.alias("node"), F.when(F.col("way") == "ambiguous", several).otherwise(1).alias("matches")), "settled")
    rest = q.join(settled, "query_id", "left_anti").where("_want <> ''")
    near = rest.join(named.where("acts and visible").select("page_id", F.lower("name").alias("_name")), "page_id").where(F.col("_name").contains(F.col("_want"))).groupBy("query_id").agg(F.count("*").alias("near"))
    framed = rest.join(frames.select("page_id", F.lower(text.clean(F.col("label"))).alias("_label")), "page_id").where(F.col("_label").contains(F.col("_want"))).groupBy("query_id").agg(F.count("*").alias("framed"))
    other = rest.join(named.where("visible and label is not null").select("page_id", F.lower("label").alias("_want"), "node"), ["page_id", "_want"]).groupBy("query_id").agg(F.count("*").alias("other"), F.min("node").alias("other_node")).where("other = 1")
    told = q.select("query_id").join(settled, "query_id", "left_anti").join(near.hint("merge"), "query_id", "left").join(framed.hint("merge"), "query_id", "left").join(other.hint("merge"), "query_id", "left")
    outcome = F.when(F.col("near") > 0, "near").when(F.col("framed") > 0, "in frame").when(F.col("other") == 1, "labelled otherwise").otherwise("not found")
    told = told.withColumn("outcome", outcome).select("query_id", "outcome", F.lit("").alias("way"), F.when(F.col("outcome") == "labelled otherwise", F.col("other_node")).alias("node"), F.when(F.col("outcome") == "near", F.col("near")).otherwise(0).alias("matches"))
    return asked.join(settled.unionByName(told).hint("merge"), "query_id")
