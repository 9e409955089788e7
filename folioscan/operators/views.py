"""Reading projections of pages: Markdown, inventory, outline, tables, search, refs, runs, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.operators import tree
from folioscan.operators.facts import attr, names, readable
from folioscan.operators.sieve import sieve
from folioscan.sources.markup import INLINE
from folioscan.sources.stored import stored

SKIPPED = ("navigation", "banner", "contentinfo", "complementary", "search")
LANDMARKS = ("banner", "complementary", "contentinfo", "form", "main", "navigation", "region", "search")
CLOSED = ("navigation", "contentinfo")
CONTROLS = ("button", "select", "input", "textarea", "option")
NOTHING = "no readable content"
NAME_CHARS = 200
MOST_BYTES = 8 << 20
SIZES = (1, 2, 3, 4, 6, 8, 12, 16)
REF_LETTERS = {"link": "l", "button": "b", "textbox": "t", "heading": "h"}


def _page() -> Window:
    return Window.partitionBy("page_id").orderBy("node")


def block_runs(facts_df: DataFrame) -> DataFrame:
    """Inline text of pages in runs: (page_id, run, node, block, piece ...). A run ends where a
    block begins or ends, or at a line break: its key is the nearest block above and the
    number of block starts before it."""
    block = (F.col("kind") == "element") & (~F.col("tag").isin(*INLINE) | (F.col("tag") == "br"))
    starts = F.sum(block.cast("int")).over(_page())
    return facts_df.withColumn("_starts", starts).withColumn("run", F.struct("block", "_starts")).drop("_starts")


def _skip(roles: tuple[str, ...]) -> Column:
    return tree.under(F.col("role").isin(*roles) | F.col("tag").isin(*CONTROLS)) | F.col("hidden")


def _anchor() -> Column:
    return (F.col("tag") == "a") & attr("href").isNotNull()


def markdown_lines(facts_df: DataFrame, skipped: tuple[str, ...] = SKIPPED, main: bool = True) -> DataFrame:
    """(page_id, pos, line): main content as Markdown lines.

    The ``main`` landmark if there is one, else the page, without navigation, headers,
    footers, asides and controls; headings, list items, quotes, code, links, emphasis, images.
    Without ``main`` all of the page but controls and what is in the landmarks ``skipped``.
    """
    has_main = F.coalesce(F.max(F.when((F.col("role") == "main") & ~F.col("hidden"), 1)).over(Window.partitionBy("page_id")), F.lit(0)) == 1
    runs = block_runs(facts_df.drop("path"))
    marked = runs.withColumns({
        "_in_main": ~has_main | tree.under(F.col("role") == "main") if main else F.lit(True),
        "_skip": _skip(skipped),
        "_bold": tree.under(F.col("tag").isin("b", "strong")),
        "_slant": tree.under(F.col("tag").isin("i", "em")),
        "_code": tree.under(F.col("tag").isin("code", "kbd", "samp")),
        "_pre": tree.under(F.col("tag") == "pre"),
        "_heading": tree.nearest(F.col("role") == "heading", F.col("level")),
        "_link": tree.nearest(_anchor(), F.struct(F.col("node").alias("n"), attr("href").alias("to"))),
        "_item": tree.under(F.col("tag") == "li"),
        "_quote": tree.under(F.col("tag") == "blockquote"),
        "_depth": F.col("lists"),
    })
    said = F.when(F.col("kind") == "text", F.col("text")).when((F.col("tag") == "img") & (attr("alt") != ""), F.concat(F.lit("!["), text.clean(attr("alt")), F.lit("]("), text.href(F.coalesce(attr("src"), F.lit(""))), F.lit(")")))
    pieces = marked.where(~F.col("_skip") & F.col("_in_main")).withColumn("piece", said).where("piece is not null")
    flat = F.regexp_replace("piece", f"[{text.BLANK}]+", " ")
    shown = F.when(F.col("_pre"), F.col("piece")).when(F.col("_code") & (F.trim(flat) != ""), F.concat(F.lit("`"), F.trim(flat), F.lit("`"))).otherwise(flat)
    emphatic = F.when((F.trim(shown) == "") | F.col("_heading").isNotNull(), shown).when(F.col("_bold"), F.regexp_replace(shown, r"^(\s*)(.*?)(\s*)$", "$1**$2**$3")).when(F.col("_slant"), F.regexp_replace(shown, r"^(\s*)(.*?)(\s*)$", "$1*$2*$3")).otherwise(shown)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", c))), lambda x: x[c]), "")
    by_link = pieces.withColumn("_shown", emphatic).groupBy("page_id", "run", F.coalesce("_link.n", "node").alias("part")).agg(F.min("node").alias("node"), joined("_shown").alias("_text"), F.first("_link.to").alias("_to"), *[F.first(c).alias(c) for c in ("_heading", "_item", "_quote", "_pre", "_depth")])
    label = text.clean(F.col("_text"))
    part = F.when(F.col("_to").isNotNull() & (label != ""), F.concat(F.regexp_extract("_text", r"^(\s*)", 1), F.lit("["), label, F.lit("]("), text.href(F.col("_to")), F.lit(")"), F.regexp_extract("_text", r"(\s*)$", 1))).otherwise(F.col("_text"))
    lines = by_link.withColumn("_part", part).groupBy("page_id", "run").agg(F.min("node").alias("pos"), joined("_part").alias("body"), *[F.first(c).alias(c) for c in ("_heading", "_item", "_quote", "_pre", "_depth")])
    body = F.when(F.col("_pre"), F.concat(F.lit("```\n"), F.array_join(text.lines(F.col("body"), spaces=True), "\n"), F.lit("\n```"))).otherwise(text.clean(F.col("body")))
    head = F.when(F.col("_heading").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("_heading")), F.lit(" "))).when(F.col("_item"), F.concat(F.repeat(F.lit("  "), F.greatest(F.col("_depth") - 1, F.lit(0))), F.lit("- "))).when(F.col("_quote"), "> ").otherwise("")
    return lines.withColumn("body", body).where("body <> '' and body <> '```\n\n```'").select("page_id", "pos", F.concat(head, "body").alias("line"))


def markdown(pages_facts: DataFrame) -> DataFrame:
    """(page_id, n_lines, markdown): one text for each page; pages without content say so."""
    lines = markdown_lines(pages_facts).groupBy("page_id").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))
    return pages_facts.select("page_id").distinct().join(lines, "page_id", "left").select("page_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("markdown", F.lit(NOTHING)).alias("markdown"))


def state_tags() -> Column:
    return F.array_compact(F.array(F.when(F.col("disabled"), "disabled"), F.when(F.coalesce("checked", F.lit(False)), "checked"), F.when(F.coalesce("selected", F.lit(False)), "selected"), F.when(F.coalesce("required", F.lit(False)), "required"), F.when(F.col("expanded"), "expanded"), F.when(~F.col("expanded"), "collapsed"), F.when(attr("download").isNotNull(), "download")))


def inventory(facts_df: DataFrame) -> DataFrame:
    """(page_id, pos, role, name, href, tags): every control that acts, in document order."""
    n = names(facts_df)
    shown = facts_df.where("interactive").join(n, ["page_id", "node"], "left")
    pos = F.row_number().over(_page()).cast("long")
    return shown.select("page_id", "node", "role", "name", attr("href").alias("href"), state_tags().alias("tags")).withColumn("pos", pos)


def refs(controls: DataFrame) -> DataFrame:
    """``controls`` with a short ref: a letter for the role and a number by first sight. Batch
    form of stable refs: within an epoch a node keeps the number of its first view."""
    letter = F.coalesce(F.create_map(*[F.lit(x) for p in REF_LETTERS.items() for x in p])[F.col("role")], F.lit("e"))
    number = F.row_number().over(Window.partitionBy("page_id", "_letter").orderBy("node"))
    return controls.withColumn("_letter", letter).withColumn("ref", F.concat(F.col("_letter"), number.cast("string"))).drop("_letter")


def _grams(c: Column, k: int) -> Column:
    """All runs of ``k`` characters, in one pass."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def _asked(sized: DataFrame, used: list[int]) -> DataFrame:
    """(term, _low, _key) of (term, _low, _size): of a term's runs the one that the fewest terms have."""
    runs = F.coalesce(*[F.when(F.col("_size") == k, _grams(F.col("_low"), k)) for k in used])
    each = sized.select("term", "_low", F.explode(F.array_distinct(runs)).alias("_key"))
    fewest = F.min_by("_key", F.struct("_terms", "_key")).alias("_key")
    return each.join(each.groupBy("_key").agg(F.count("*").alias("_terms")).hint("merge"), "_key").groupBy("term", "_low").agg(fewest)


def _holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``texts`` (page_id, node, t, ...) with each ``term`` they hold, in any letter case. A text
    that holds a term holds all its runs of characters, so both meet on one of them: of the
    greatest of SIZES that the term is long enough for, the run that the fewest terms have.
    Terms that share most of their words thus meet where they differ. The text's runs carry its
    number alone, and those that no term asks for are left out before."""
    low = F.lower("term")
    size = F.coalesce(*[F.when(F.char_length("_low") >= k, k) for k in reversed(SIZES)])
    sized = terms.where("term <> ''").select("term", low.alias("_low")).distinct().withColumn("_size", size)
    used = sorted(k for (k,) in sized.select("_size").distinct().collect())  # of SIZES
    if not used:
        return texts.join(sized.select("term"), F.lit(False))
    asked = _asked(sized, used).hint("merge")
    meets = sieve(asked, "_key")
    keys = F.concat(*[_grams(F.col("t"), k) for k in used])
    met = texts.select("page_id", "node", F.explode(F.array_distinct(F.filter(keys, lambda k: meets(k)))).alias("_key")).join(asked, "_key").drop("_key").distinct()
    return texts.join(met.hint("merge"), ["page_id", "node"]).where(F.col("t").contains(F.col("_low"))).drop("_low")


def search(facts_df: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, page_id, hits): texts that hold a term, in any letter case; a hit inside a
    control counts once. Terms of any number; empty ones hit nothing."""
    cleaned = facts_df.where((F.col("kind") == "text") & ~F.col("hidden")).select("page_id", "node", "path", F.lower(text.clean(F.col("text"))).alias("t"))
    control = facts_df.where("interactive").select("page_id", F.col("node").alias("c"))
    inside = cleaned.select("page_id", "node", F.explode("path").alias("c")).join(control, ["page_id", "c"]).groupBy("page_id", "node").agg(F.max("c").alias("c"))
    met = _holding(cleaned.select("page_id", "node", "t"), terms).join(inside, ["page_id", "node"], "left")
    return met.groupBy("term", "page_id").agg(F.countDistinct(F.coalesce("c", "node")).alias("hits"))


def search_phrases(facts_df: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, page_id, node): paragraphs that hold a term though no single text of theirs does,
    as a page splits a phrase over emphasis and links. A paragraph is a visible block that is
    no control and holds text in lines alone."""
    block = (F.col("kind") == "element") & ~F.col("tag").isin(*INLINE, "br")
    rows = facts_df.withColumn("_block", block).withColumn("_holds", tree.holds(F.col("_block")))
    paragraphs = rows.where("_block and not _holds and not hidden and not interactive").select("page_id", F.col("node").alias("root"))
    pieces = readable(facts_df).where("kind = 'text' or tag = 'img'")
    whole = tree.text_of(pieces, paragraphs).select("page_id", F.col("root").alias("node"), F.lower(text.clean(F.col("content"))).alias("t"))
    found = _holding(whole, terms).select("term", "page_id", "node")
    single = pieces.where("kind = 'text'").select("page_id", "node", F.explode("path").alias("root"), F.lower(text.clean(F.col("text"))).alias("t"))
    told = found.join(single.withColumnsRenamed({"node": "_text", "root": "node"}), ["page_id", "node"]).where(F.col("t").contains(F.lower("term"))).select("term", "page_id", "node").distinct()
    return found.join(told.hint("merge"), ["term", "page_id", "node"], "left_anti")


def expand(facts_df: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of the subtrees of (page_id, root)."""
    r = roots.select(F.col("page_id"), F.col("root"))
    ends = facts_df.select("page_id", F.col("node").alias("root"), F.col("end").alias("_to")).join(r, ["page_id", "root"])
    return facts_df.join(ends, "page_id").where("node >= root and node < _to").drop("_to")


def sibling_runs(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, parent, first, length): the longest run of at least ``least`` siblings of one
    shape under each parent, the first of equals. A shape is the tags below, by depth."""
    below = nodes.where("kind = 'element'").select("page_id", "node", "depth", "tag", F.explode(F.array_union("path", F.array("node"))).alias("root"))
    roots = nodes.where("kind = 'element' and parent is not null").select("page_id", F.col("node").alias("root"), F.col("parent"), F.col("depth").alias("_d"))
    shape = below.join(roots, ["page_id", "root"]).groupBy("page_id", "parent", "root").agg(F.xxhash64(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", (F.col("depth") - F.col("_d")).alias("d"), "tag"))), lambda x: F.concat_ws(":", x["d"].cast("string"), x["tag"])), " ")).alias("shape"))
    w = Window.partitionBy("page_id", "parent").orderBy("root")
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("page_id", "parent", "shape").orderBy("root"))
    groups = shape.withColumn("island", island).groupBy("page_id", "parent", "shape", "island").agg(F.min("root").alias("first"), F.count("*").alias("length")).where(F.col("length") >= least)
    best = F.row_number().over(Window.partitionBy("page_id", "parent").orderBy(F.col("length").desc(), "first"))
    return groups.withColumn("_r", best).where("_r = 1").select("page_id", "parent", "first", "length")


def _control_lines(facts_df: DataFrame) -> DataFrame:
    """(page_id, pos, line): role, name and state of the controls outside closed landmarks, but for
    the links that a line of text shows. Flags alone are sorted to find them; names are asked on
    the pages that have any, whose ids go to the facts unless they exceed MOST_BYTES."""
    words = F.when(F.col("kind") == "text", F.col("text")).when(F.col("tag") == "img", attr("alt"))
    flags = {"_landmark": F.col("role").isin(*CLOSED), "_form": F.col("tag").isin(*CONTROLS), "_link": _anchor(), "_said": F.coalesce(text.clean(words) != "", F.lit(False)) & ~F.col("hidden")}
    acts = F.when(F.col("interactive"), F.struct("role", state_tags().alias("tags"))).alias("_acts")
    rows = facts_df.select("page_id", "node", "end", acts, *[c.alias(k) for k, c in flags.items()])
    rows = rows.withColumns({"_closed": tree.under(F.col("_landmark")), "_held": tree.under(F.col("_form"))})
    told = F.col("_link") & ~F.col("_held") & tree.holds(F.col("_said") & ~F.col("_closed") & ~F.col("_held"))
    acting = stored(rows.withColumn("_told", told).where("_acts is not null and not _closed and not _told").select("page_id", "node", "_acts.*"), "acting")
    pages = acting.select("page_id").distinct()
    size = pages.agg(F.coalesce(F.sum(F.octet_length(F.col("page_id").cast("string")) + 16), F.lit(0))).first()[0]
    named = names(facts_df.join(F.broadcast(pages) if size <= MOST_BYTES else pages, "page_id", "left_semi"))
    name = F.when(F.col("name") != "", text.quote(F.col("name"), NAME_CHARS))
    return acting.join(named.drop("source"), ["page_id", "node"], "left").select("page_id", F.col("node").alias("pos"), F.concat_ws(" ", "role", name, "tags").alias("line"))


def outline(facts_df: DataFrame) -> DataFrame:
    """(page_id, pos, indent, line): headings, landmarks with counts, text blocks and controls of
    the whole page.

    Every landmark is a line with its number of links. Navigation and footers are that line
    alone; what other landmarks hold stands below theirs, text runs and controls in order.
    ``indent`` is the number of landmarks around a line, a sum of their starts and ends up to it.
    """
    counted = tree.subtree_count(facts_df.withColumn("_is_link", (F.col("role") == "link") & ~F.col("hidden")), F.col("_is_link"), "links")
    opened = counted.withColumn("_inner", tree.under(F.col("role").isin(*CLOSED))).where(F.col("role").isin(*LANDMARKS) & ~F.col("hidden") & ~F.col("_inner"))
    said = F.concat(F.col("role"), F.lit(" ("), F.col("links").cast("string"), F.lit(" links)"))
    row = lambda pos, turn, step, line: F.struct(F.col(pos).alias("pos"), F.lit(turn).alias("turn"), F.lit(step).alias("step"), line.alias("line"))
    none = F.lit(None).cast("string")
    marks = opened.select("page_id", F.inline(F.array(row("node", 1, 0, said), row("node", 2, 1, none), row("end", 0, -1, none))))
    lines = markdown_lines(facts_df, CLOSED, main=False).unionByName(_control_lines(facts_df))
    rows = marks.unionByName(lines.select("page_id", "pos", F.lit(1).alias("turn"), F.lit(0).alias("step"), "line"))
    around = F.sum("step").over(Window.partitionBy("page_id").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("indent", around.cast("int")).where("turn = 1").select("page_id", "pos", "indent", "line")


def tables_tsv(facts_df: DataFrame) -> DataFrame:
    """(page_id, table, row, tsv): cells of each table row joined by tabs; tables that hold
    tables are layout and left out."""
    cells = facts_df.where(F.col("tag").isin("td", "th") & ~F.col("hidden"))
    holds = facts_df.where("tag = 'table'").select("page_id", F.explode("path").alias("node")).distinct()
    tables = facts_df.where("tag = 'table'").join(holds, ["page_id", "node"], "left_anti").select("page_id", F.col("node").alias("table"))
    rows = facts_df.where("tag = 'tr'").select("page_id", F.col("node").alias("tr"))
    contents = tree.text_of(readable(facts_df), cells.select("page_id", F.col("node").alias("root"))).withColumn("content", text.clean(F.col("content")))
    placed = cells.select("page_id", "node", F.explode("path").alias("up")).join(tables, (F.col("up") == F.col("table")) & (tables["page_id"] == cells["page_id"])).select(cells["page_id"], "node", "table")
    in_row = cells.select("page_id", "node", F.col("parent").alias("tr")).join(rows, ["page_id", "tr"])
    full = placed.join(in_row, ["page_id", "node"]).join(contents.withColumnRenamed("root", "node"), ["page_id", "node"], "left")
    tsv = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "\t")
    return full.groupBy("page_id", "table", F.col("tr").alias("row")).agg(tsv.alias("tsv")).where("trim(replace(tsv, '\t', '')) <> ''")


def markdown_tables(tsv_rows: DataFrame) -> DataFrame:
    """(page_id, table, markdown): pipe tables where all rows have the same two or more cells,
    else plain lines."""
    rows = tsv_rows.withColumn("cells", F.split("tsv", "\t"))
    per = rows.groupBy("page_id", "table").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"), F.min(F.size("cells")).alias("lo"), F.max(F.size("cells")).alias("hi"))
    escaped = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r["cells"], lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    pipe = F.transform("rows", escaped)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("hi")))
    piped = F.concat(F.slice(pipe, 1, 1), F.array(rule), F.slice(pipe, F.lit(2), F.size(pipe)))
    plain = F.transform("rows", lambda r: F.array_join(r["cells"], " "))
    return per.select("page_id", "table", F.array_join(F.when((F.col("lo") == F.col("hi")) & (F.col("hi") >= 2), piped).otherwise(plain), "\n").alias("markdown"))


def fit_lines(lines: DataFrame, budget_tokens: int, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Lines kept within a budget of four characters a token: classes in turn (``rank``, lesser
    first, then ``pos``), while the running count of characters and line ends allows."""
    order = Window.partitionBy(*by).orderBy("rank", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.char_length("line") + 1).over(order)
    return lines.withColumn("kept", used <= budget_tokens * 4)


def class_rank(line: Column) -> Column:
    """Keep order of Markdown lines: headings, then links and items, then text."""
    return F.when(line.startswith("#"), 0).when(line.rlike(r"^\s*- |\]\("), 1).otherwise(2)
