"""The outline of a page: repeated siblings become lists of entries, wrappers that only lay
things out dissolve, and lines are kept within a budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.operators import folds, tree
from folioscan.operators.facts import names
from folioscan.operators.views import block_runs
from folioscan.sources.markup import INLINE
from folioscan.sources.stored import stored

# The word and the ref letter of a line by role.
REGIONS = {"main": "main", "banner": "header", "contentinfo": "footer r", "navigation": "nav r", "complementary": "aside", "form": "form", "region": "region", "article": "article", "list": "list", "listitem": "item", "table": "table r", "grid": "table r", "row": "row", "dialog": "dialog d", "alertdialog": "dialog d"}
CONTROLS = {"link": "link a", "button": "button b", "tab": "tab b", "menuitem": "menuitem b", "menuitemcheckbox": "menuitem b", "menuitemradio": "menuitem b", "option": "option b", "textbox": "textbox f", "searchbox": "searchbox f", "spinbutton": "spinbutton f", "checkbox": "checkbox f", "radio": "radio f", "switch": "switch f", "combobox": "select f", "listbox": "listbox f", "slider": "slider f"}
# The order in which lines are kept, dialogs first; entries of a run that count as first.
DIALOG, ACTIVE, PROSE, FIRST, NAV, FOOTER, LATER = 0, 2, 3, 4, 5, 6, 7
FIRST_ENTRIES = 3
LEAST_CUT = 24
NAME_CHARS = 200


@dataclass(slots=True)
class _Item:
    """A box, control or text of a page while its tree is put in shape."""

    node: int
    head: str
    kind: str
    name: str
    sort: str
    kids: list = field(default_factory=list)
    run: int = -1
    repeat: int = 0
    shape: int = 0
    entry: bool = False

    def settle(self) -> _Item:
        """Sum up what a parent asks: the shape, a box around one thing having that thing's;
        and whether it reads as an entry: it acts, has parts, or holds something that does."""
        if self.head == "" and len(self.kids) == 1:
            self.shape = self.kids[0].shape
        else:
            self.shape = hash((self.head, tuple(k.shape for k in self.kids)))
        acts = self.head in ("item", "row") or self.kind in ("a", "b", "f")
        self.entry = acts or len(self.kids) > 1 or any(k.entry and k.repeatable for k in self.kids)
        return self

    @property
    def repeatable(self) -> bool:
        return self.entry and self.sort != "text" and self.head not in ("heading", "img")

    @property
    def flat(self) -> bool:
        return self.head in ("item", "row") and bool(self.kids) and all(k.sort != "box" for k in self.kids)


def _longest_run(kids: list[_Item], least: int) -> tuple[int, int]:
    """(first, length) of the longest stretch of entries of one shape, the first of equals."""
    best, first = (0, 0), 0
    for k, it in enumerate(kids):
        if not it.repeatable:
            first = k + 1
            continue
        if kids[first].shape != it.shape:
            first = k
        if k + 1 - first > best[1]:
            best = first, k + 1 - first
    return best if best[1] >= least else (0, 0)


def _listed(owner: _Item, members: list[_Item]) -> None:
    owner.repeat, owner.head = len(members), owner.head or "list"
    for k, it in enumerate(members):
        it.run = k


def _entries(kids: list[_Item]) -> list[_Item]:
    """Boxes without a word of their own give way to what they hold, as do tables and rows of
    nothing but tables; in a run such a box stays as an entry, unless it holds one thing, which
    takes its place."""
    out: list[_Item] = []
    for k in kids:
        only_layout = k.head in ("table", "row") and not k.repeat and k.kids and all(x.head == "table" for x in k.kids)
        if only_layout or (k.head == "" and k.run < 0):
            out += k.kids
        elif k.head == "" and len(k.kids) == 1:
            k.kids[0].run = k.run
            out += k.kids
        else:
            if k.head == "":
                k.head = "item"
                k.settle()
            out.append(k)
    return out


def _in_shape(it: _Item) -> _Item:
    """A box whose kids are in shape: its longest run of equals becomes a list, the box itself
    where it holds nothing else, and a list of rows can be read as a table."""
    first, n = _longest_run(it.kids, 2 if it.head in ("list", "table") else 3)
    if n and it.head == "" and n < len(it.kids):
        inner = _Item(it.node, "", "", "", "box", it.kids[first : first + n])
        _listed(inner, inner.kids)
        it.kids[first : first + n] = [_closed(inner)]
    elif n:
        _listed(it, it.kids[first : first + n])
    return _closed(it)


def _closed(it: _Item) -> _Item:
    it.kids = _entries(it.kids)
    lead = next((k for k in it.kids if k.run >= 0), None)
    if it.head == "list" and not it.kind and it.repeat and lead is not None and lead.flat and len(lead.kids) > 1:
        it.kind = "r"
    return it.settle()


def _rows(top: list[_Item]) -> list[tuple]:
    """The finished tree, one row an item, with its keep class: what a region or a place in a run
    allows at best, and for boxes the best of what they hold."""
    out: list[list] = []

    def walk(it: _Item, up: int, indent: int, floor: int) -> int:
        floor = max(floor, {"nav": NAV, "footer": FOOTER}.get(it.head, 0))
        shown = it.head != ""
        at = len(out)
        if shown:
            out.append([at, up, 0, indent, it.node, it.head, it.kind, it.name, it.run, it.repeat, it.flat, 0])
        own = ACTIVE if it.kind in ("a", "b", "f") or it.head == "heading" else PROSE
        best = LATER + 1 if it.kids else max(floor, own)
        for k in it.kids:
            place = floor if k.run < 0 or not it.repeat else max(floor, FIRST) if k.run < FIRST_ENTRIES else LATER
            best = min(best, walk(k, at if shown else up, indent + shown, place))
        if it.head in ("nav", "footer"):
            best = min(floor, ACTIVE) if it.head == "nav" else floor
        if it.head == "dialog":
            best = DIALOG
        if shown:
            out[at][2], out[at][-1] = len(out), best
        return best

    for it in _entries(top):
        walk(it, -1, 0, PROSE)
    return [tuple(r) for r in out]


ENTRY = "pos int, up int, end int, indent int, node int, head string, kind string, name string, run int, repeat int, flat boolean, class int"


def arrange(items: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(by, pos, up, end, indent, node, head, kind, name, run, repeat, flat, class): the outline
    of each page. ``items`` (by, node, parent, sort, head, kind, name) are boxes, leaves and
    texts in document order; rows of sort '' only pass on what they hold. ``up`` is the pos of
    the enclosing line, -1 for none. One pass over the sorted rows; a page's tree is held."""

    def close(x: list, kids: list) -> tuple[list[_Item], list[tuple]]:
        root, sort, head, kind, name, node = x
        held = [it for k in kids for it in k]
        if sort:
            it = _Item(node, head, kind, name, sort, held if sort == "box" else [])
            held = [_in_shape(it) if sort == "box" else it.settle()]
        return held, _rows(held) if root else []

    rows = items.withColumns({"_root": F.col("parent").isNull(), "_node": F.col("node")})
    return folds.gathered(rows, by, ("_root", "sort", "head", "kind", "name", "_node"), close, ENTRY)


def _word(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])[F.col("role")]


def items(facts_df: DataFrame) -> DataFrame:
    """Rows for ``arrange`` from the facts of pages: controls, headings and named images are
    leaves, whatever they hold; runs of words in a line are texts, links after the run's first
    word included; other elements are boxes, those within a line only pass on."""
    page = Window.partitionBy("page_id").orderBy("node")
    words = (F.col("kind") == "text") & ~F.col("hidden") & (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    shown = (F.col("kind") == "element") & ~F.col("hidden")
    control = shown & (F.col("interactive") | F.col("clickable") | (F.col("role") == "heading") | ((F.col("role") == "img") & (F.coalesce(F.col("attrs")["alt"], F.col("attrs")["aria-label"], F.col("attrs")["title"], F.lit("")) != "")))
    linked = tree.under(shown & (F.col("role") == "link"))
    rows = block_runs(facts_df).withColumns({"_words": words, "_control": control, "_inside": tree.under(control & (F.col("role") != "link")), "_linked": linked})
    in_run = Window.partitionBy("page_id", "run").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    told = F.coalesce(F.max(F.when(F.col("_words") & ~F.col("_inside") & ~F.col("_linked"), 1)).over(in_run), F.lit(0)) == 1
    rows = rows.withColumn("_leaf", F.col("_control") & ~((F.col("role") == "link") & told))
    rows = rows.withColumn("_under", tree.under(F.col("_leaf"))).where(~F.col("_under"))
    split = F.sum(F.col("_leaf").cast("int")).over(page)
    spoken = rows.withColumn("_split", split).where((F.col("kind") == "text") & ~F.col("hidden"))
    runs = spoken.groupBy("page_id", "run", "_split").agg(F.min(F.when(F.col("_words"), F.struct("node", "parent"))).alias("at"), F.array_sort(F.collect_list(F.struct("node", "text"))).alias("t")).where("at is not null")
    texts = runs.select("page_id", "at.node", "at.parent", F.lit("text").alias("sort"), F.lit("text").alias("head"), F.lit("").alias("kind"), text.clean(F.array_join(F.transform("t", lambda x: x["text"]), "")).alias("name"))
    rest = rows.where((F.col("kind") == "document") | (shown & (F.col("tag") != "option")))
    said = names(facts_df).select("page_id", "node", "name")
    word = F.coalesce(F.when(F.col("role") == "heading", "heading").when(F.col("role") == "img", "img"), F.when(F.col("_leaf"), F.coalesce(_word(CONTROLS), F.lit("button b"))), _word(REGIONS), F.lit(""))
    sort = F.when(F.col("_leaf"), "leaf").when((word == "") & F.col("tag").isin(*INLINE), "").otherwise("box")
    boxes = rest.join(said, ["page_id", "node"], "left").select("page_id", "node", "parent", sort.alias("sort"), F.split(word, " ")[0].alias("head"), F.coalesce(F.get(F.split(word, " "), F.lit(1)), F.lit("")).alias("kind"), F.when(word.isin("item", "row", "list"), "").otherwise(F.coalesce("name", F.lit(""))).alias("name"))
    return boxes.unionByName(texts)


def outline_lines(entries: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(by, pos, up, node, class, rank, ref, line) of an outline: regions, headings, texts and
    controls, two spaces a level. Navigation and footers are one line with their number of
    links; entries of leaves alone share a line. Refs are numbered by letter in order."""
    moved = entries.withColumnsRenamed({"node": "_node", "pos": "node"})
    closed = F.col("head").isin("nav", "footer")
    inner = tree.under(closed, by)
    rows = tree.subtree_count(moved.withColumn("_inner", inner), F.col("kind") == "a", "links", by).withColumnsRenamed({"node": "pos", "_node": "node"})
    number = F.row_number().over(Window.partitionBy(*by, "kind").orderBy("_inner", "pos"))
    ref = F.when(F.col("kind") != "", F.concat("kind", number.cast("string"))).otherwise("")
    shown = F.when(F.col("name") != "", text.quote(F.col("name"), NAME_CHARS)).otherwise("")
    label = F.concat_ws(" ", F.col("head"), F.nullif("ref", F.lit("")), F.when((F.col("repeat") > 0) & ~closed, F.concat(F.lit("x"), F.col("repeat").cast("string"))))
    said = F.concat_ws(" ", "_label", F.nullif("_shown", F.lit("")), F.when(closed, F.concat(F.lit("collapsed "), F.col("links").cast("string"), F.lit(" links"))))
    rows = rows.withColumn("ref", ref).where("not _inner").withColumns({"_label": label, "_shown": shown}).withColumn("_said", said)
    cells = rows.alias("c").groupBy(*by, F.col("up").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), "_said"))), lambda x: x["_said"]), " ").alias("_cells"))
    flat = rows.select(*by, F.col("pos").alias("up")).where("flat")
    rows = rows.join(flat.withColumn("_cell", F.lit(True)), [*by, "up"], "left").where("_cell is null").join(cells, [*by, "pos"], "left")
    body = F.concat_ws(" ", "_said", F.when(F.col("flat"), F.col("_cells")))
    rank = F.when(F.col("head").isin("heading", "nav"), 0).otherwise(1)
    return rows.select(*by, "pos", "up", "indent", "node", "class", rank.alias("rank"), "ref", F.concat(F.repeat(F.lit("  "), F.col("indent")), body).alias("line"))


# Pieces of a Markdown line that a cut must not divide: links, emphasis, code; then blanks and words.
_WHOLE = r"!?\[[^\]]*\]\([^)]*\)|\*\*[^*]+\*\*|~~[^~]+~~|\*[^*]+\*|`[^`]*`"
_PIECES = rf"{_WHOLE}|\s+|(?:(?!{_WHOLE})\S)+"


def cut_line(line: Column, room: Column) -> Column:
    """The longest start of ``line`` of at most ``room`` characters that ends between words and
    outside links, emphasis and code; a word that is longer than the room where nothing comes
    before is cut where it is. Null where less than 24 characters remain."""
    pieces = F.regexp_extract_all(line, F.lit(_PIECES), F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    taken = F.aggregate(pieces, start, lambda a, p: F.when(a["open"] & (a["n"] + F.char_length(p) <= room), F.struct((a["n"] + F.char_length(p)).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("open"))))["n"]
    whole = F.rtrim(F.substring(line, F.lit(1), taken))
    word = F.regexp_extract(line, rf"^\s*(?:(?!{_WHOLE})\S)+", 0)
    least = F.char_length(whole) >= LEAST_CUT
    hard = F.substring(line, F.lit(1), room)
    return F.when(least, whole).when((F.char_length(word) > room) & (room >= LEAST_CUT), hard)


def turns(lines: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``lines`` as a written table with their turn in the keep order and what no budget changes:
    the widths of the line, of a new ref and of a marker in its place, and the turn of the line
    before. Any number of budgets is fitted to one such table."""
    earliest = folds.gathered(
        lines.select(*by, F.col("pos").alias("node"), F.when(F.col("up") >= 0, F.col("up")).alias("parent"), "class", "rank", F.col("pos").alias("_pos")),
        by, ("class", "rank", "_pos"), _first_of, "pos int, k1 int, k2 int, k3 int",
    )
    page = Window.partitionBy(*by)
    turn, lines_of_page = F.row_number().over(page.orderBy("k1", "k2", "k3", "pos")), F.count("*").over(page)
    rows = lines.join(earliest, [*by, "pos"]).withColumns({"turn": turn, "_all": lines_of_page, "_width": F.char_length("line") + 1}).drop("k1", "k2", "k3")
    digits = F.char_length((2 * F.col("_all") + 1).cast("string"))  # of any count, and of any new ref
    rows = rows.withColumn("_ref_width", F.greatest(F.max(F.char_length("ref")).over(page), 1 + digits))
    gap = 2 * F.col("indent") + len("…  more lines ") + digits + F.col("_ref_width") + 1
    return stored(rows.withColumns({"_from": F.coalesce(F.lag("turn").over(page.orderBy("pos")), F.lit(0)), "_gap": gap}).drop("_all"), "turns")


def fit(lines: DataFrame, budget_tokens: int, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``fit_turns`` of lines that one budget alone is asked for."""
    return fit_turns(turns(lines, by), budget_tokens, by)


def fit_turns(rows: DataFrame, budget_tokens: int, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(by, pos, what, ref, opens, line) of the lines that a budget of four characters a token
    keeps, with a marker for each run of dropped lines: how many, and the ref that opens them,
    that of the enclosing line if it is kept and has one; ``opens`` is the node of a new ref.

    ``rows`` are ``turns`` of lines (by, pos, up, indent, node, class, rank, ref, line), which
    come in the order of their class, then rank, then place, enclosing lines together with their first; the longest affordable
    start of that order is kept. What a start costs is a prefix sum: a line's own characters
    from its turn on, and a marker's from the turn of the line before a gap to that of the line
    after its first. Markers are reckoned at their widest, so the budget always holds. A line
    longer than the whole budget is cut to the room that is left.
    """
    limit = 4 * budget_tokens
    page = Window.partitionBy(*by)
    in_order = page.orderBy("pos")
    opens = F.col("_from") < F.col("turn")
    steps = rows.select(*by, F.col("turn").alias("n"), (F.col("_width") - F.when(opens, F.col("_gap")).otherwise(0)).cast("long").alias("cost"))
    steps = steps.unionByName(rows.where(opens).select(*by, F.col("_from").alias("n"), F.col("_gap").cast("long").alias("cost")))
    upto = page.orderBy("n")
    cost = steps.groupBy(*by, "n").agg(F.sum("cost").alias("cost")).withColumn("total", F.sum("cost").over(upto)).withColumn("next", F.lead("total").over(upto))
    last = cost.where(F.col("total") <= limit).groupBy(*by).agg(F.max("n").alias("_kept"), F.max_by("next", "n").alias("_next"))
    rows = rows.join(last.hint("merge"), list(by)).hint("merge")  # a budget that no marker fits keeps nothing
    room = (limit - (F.col("_next") - F.col("_width")) - len("… ") - F.col("_ref_width") - 1).cast("int")
    cut = F.when((F.col("turn") == F.col("_kept") + 1) & (F.col("_width") > limit) & (room > 0), cut_line(F.col("line"), room))
    rows = rows.withColumns({"_keep": F.col("turn") <= F.col("_kept"), "_cut": cut}).withColumn("_stays", F.col("_keep") | F.col("_cut").isNotNull())
    mints_cut = F.col("_cut").isNotNull() & (F.col("ref") == "")
    rows = rows.withColumns({"_island": F.sum(F.col("_stays").cast("int")).over(in_order), "_used": F.count_if(F.col("ref").startswith("r")).over(page) + F.max(mints_cut.cast("int")).over(page)})
    fresh = F.concat(F.lit("r"), F.col("_used").cast("string"))
    above = rows.where("_stays").select(*by, F.col("pos").alias("up"), F.col("ref").alias("_up_ref"), F.col("node").alias("_up_node"))
    dropped = rows.where("not _stays").groupBy(*by, "_island").agg(F.min_by(F.struct("pos", "up", "indent", "node", "ref", "_used"), "pos").alias("f"), F.count("*").alias("n")).select(*by, "f.*", "n")
    marks = dropped.join(above, [*by, "up"], "left").withColumn("_given", F.coalesce(F.nullif("_up_ref", F.lit("")), F.when(F.coalesce("_up_ref", F.lit("")) == "", F.nullif("ref", F.lit("")))))
    minted = F.sum(F.col("_given").isNull().cast("int")).over(in_order)
    marks = marks.withColumn("ref", F.coalesce("_given", F.concat(F.lit("r"), (F.col("_used") + minted).cast("string"))))
    more = F.concat(F.repeat(F.lit("  "), F.col("indent")), F.lit("… "), F.col("n").cast("string"), F.when(F.col("n") == 1, " more line ").otherwise(" more lines "), F.col("ref"))
    markers = marks.select(*by, "pos", F.lit("marker").alias("what"), "ref", F.when(F.col("_given").isNull(), F.coalesce("_up_node", "node")).cast("int").alias("opens"), more.alias("line"))
    cut_ref = F.coalesce(F.nullif("ref", F.lit("")), fresh)
    kept = rows.where("_stays").select(*by, "pos", F.when(F.col("_keep"), "line").otherwise("cut").alias("what"), F.when(F.col("_keep"), F.col("ref")).otherwise(cut_ref).alias("ref"), F.when(mints_cut, F.col("node")).cast("int").alias("opens"), F.when(F.col("_keep"), F.col("line")).otherwise(F.concat(F.col("_cut"), F.lit("… "), cut_ref)).alias("line"))
    # dealt apart: a union of two sides dealt alike is taken for dealt itself, which AQE may undo
    return kept.unionByName(markers.repartition(*by, "pos"))


def _first_of(x: list, kids: list) -> tuple[tuple, list[tuple]]:
    """The earliest place in the keep order of a line or of what it encloses."""
    least = min([tuple(x), *kids])
    return least, [(x[2], *least)]
