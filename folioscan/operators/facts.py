"""Facts of nodes: role, level, visibility, state, name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.operators import tree
from folioscan.sources.markup import INLINE
from folioscan.sources.stored import dealt, stored

# Roles by tag, roles that take part in interaction, tags that are never rendered.
TAG_ROLES = {"article": "article", "aside": "complementary", "button": "button", "details": "group", "dialog": "dialog", "fieldset": "group", "form": "form", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "hr": "separator", "li": "listitem", "main": "main", "menu": "list", "meter": "meter", "nav": "navigation", "ol": "list", "option": "option", "output": "status", "progress": "progressbar", "summary": "button", "table": "table", "tbody": "rowgroup", "td": "cell", "textarea": "textbox", "tfoot": "rowgroup", "thead": "rowgroup", "tr": "row", "ul": "list"}
INPUT_ROLES = {"": "textbox", "button": "button", "checkbox": "checkbox", "color": "button", "date": "textbox", "datetime-local": "textbox", "email": "textbox", "file": "button", "image": "button", "month": "textbox", "number": "spinbutton", "password": "textbox", "radio": "radio", "range": "slider", "reset": "button", "search": "searchbox", "submit": "button", "tel": "textbox", "text": "textbox", "time": "textbox", "url": "textbox", "week": "textbox"}
STRUCTURE = ("article", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "li", "main", "menu", "nav", "ol", "table", "ul")
INTERACTIVE = ("button", "checkbox", "combobox", "link", "listbox", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "radio", "searchbox", "slider", "spinbutton", "switch", "tab", "textbox", "treeitem")
NEVER_RENDERED = ("base", "head", "link", "meta", "noscript", "script", "style", "template", "title")
FORM_TAGS = ("button", "fieldset", "input", "optgroup", "option", "select", "textarea")
NAMED_BY_CONTENT = ("button", "cell", "checkbox", "columnheader", "heading", "link", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "radio", "rowheader", "switch", "tab")
VOID_ROLES = ("", "presentation", "none")

attr = lambda name: F.col("attrs")[name]


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])[key]


def _among(flag: Column, what: Column | None = None) -> Column:
    """The flagged nodes of the page, few by their kind, as an array."""
    return F.collect_set(F.when(flag, F.col("node") if what is None else what)).over(Window.partitionBy("page_id"))


def _tag_role() -> Column:
    """The role by tag; a header or footer as it is outside sections."""
    kind = F.lower(F.coalesce(attr("type"), F.lit("")))
    many = attr("multiple").isNotNull() | F.coalesce(attr("size").try_cast("int") > 1, F.lit(False))
    return (
        F.when(F.col("tag").isin("a", "area"), F.when(attr("href").isNotNull(), "link").otherwise(""))
        .when(F.col("tag") == "input", F.coalesce(_map(INPUT_ROLES, kind), F.lit("")))
        .when(F.col("tag") == "select", F.when(many, "listbox").otherwise("combobox"))
        .when(F.col("tag") == "img", F.when(attr("alt") == "", "").otherwise("img"))
        .when(F.col("tag") == "th", F.when(attr("scope") == "row", "rowheader").otherwise("columnheader"))
        .when(F.col("tag") == "section", F.when(attr("aria-label").isNotNull() | attr("aria-labelledby").isNotNull(), "region").otherwise(""))
        .when(F.col("tag") == "header", "banner")
        .when(F.col("tag") == "footer", "contentinfo")
        .otherwise(F.coalesce(_map(TAG_ROLES, F.col("tag")), F.lit("")))
    )


def _structure() -> Column:
    return F.col("tag").isin(*STRUCTURE) | (F.col("tag") == "a") & attr("href").isNotNull() | F.lower(F.coalesce(attr("role"), F.lit(""))).isin("heading", "link", "list", "navigation", "table")


def role() -> Column:
    """The explicit role's first token, unless it is none or presentation, else by tag; an
    editing host without structure of its own is a text box. Reads what ``facts`` has asked
    the page before: ``_tag_role``, ``_sectioned``, ``_structured``, ``_editables``."""
    explicit = F.get(F.split(F.trim(F.lower(F.coalesce(attr("role"), F.lit("")))), r"\s+"), F.lit(0))
    by_tag = F.when(F.col("tag").isin("header", "footer") & F.col("_sectioned"), "").otherwise(F.col("_tag_role"))
    host = _editable() & ~F.coalesce(F.array_contains("_editables", F.col("parent")), F.lit(False)) & ~F.col("_structured")
    return F.when(F.col("kind") != "element", "").when(~explicit.isin(*VOID_ROLES), explicit).otherwise(F.when((by_tag == "") & host, "textbox").otherwise(by_tag))


def _editable() -> Column:
    return F.coalesce(F.lower(F.trim(attr("contenteditable"))) != "false", F.lit(False))


def _pointed() -> Column:
    return F.coalesce(F.lower(attr("style")).rlike(r"(?:^|;)\s*cursor\s*:\s*pointer"), F.lit(False))


def level() -> Column:
    """Heading level: hN, overridden by aria-level 1 to 6, 2 where neither says."""
    own = F.regexp_extract("tag", r"^h([1-6])$", 1).try_cast("int")
    said = F.regexp_extract(F.coalesce(attr("aria-level"), F.lit("")), r"^\s*([1-6])\s*$", 1).try_cast("int")
    return F.when(F.col("role") == "heading", F.coalesce(said, own, F.lit(2)))


def hidden_by_itself() -> Column:
    style = F.lower(F.regexp_replace(F.coalesce(attr("style"), F.lit("")), r"\s+", ""))
    input_hidden = (F.col("tag") == "input") & (F.lower(F.coalesce(attr("type"), F.lit(""))) == "hidden")
    said = F.when(F.contains(style, F.lit("opacity:")), F.regexp_extract(style, r"(?:^|;)opacity:([^;!]*)", 1))  # a cast that fails is slow
    faint = F.coalesce(said.try_cast("double") <= 0.01, F.lit(False))
    return (F.col("kind") == "element") & (F.col("tag").isin(*NEVER_RENDERED) | attr("hidden").isNotNull() | input_hidden | faint | style.rlike(r"(?:^|;)(?:display:none|visibility:(?:hidden|collapse))(?:;|!|$)"))


def disabled() -> Column:
    """Own attribute on form tags, aria-disabled, a disabled optgroup around an option, or a
    disabled fieldset above a control that is not inside that fieldset's first legend."""
    own = (F.col("tag").isin(*FORM_TAGS) & attr("disabled").isNotNull()) | (attr("aria-disabled") == "true")
    control = F.col("tag").isin("button", "fieldset", "input", "select", "textarea")
    excused = F.size(F.array_intersect("path", F.col("_legends")))  # first legends of disabled fieldsets above
    above = F.size(F.array_intersect("path", "_shut"))
    return F.coalesce(own, F.lit(False)) | control & (above > excused) | (F.col("tag") == "option") & F.coalesce(F.array_contains("_groups", F.col("parent")), F.lit(False))


def _first_legend() -> Column:
    """The first legend child of a disabled fieldset, ``_legends`` being those of the page."""
    earlier = F.exists("_legends", lambda x: (x["parent"] == F.col("parent")) & (x["node"] < F.col("node")))
    return F.when((F.col("tag") == "legend") & F.coalesce(F.array_contains("_shut", F.col("parent")), F.lit(False)), ~earlier).otherwise(False)


def destination_tags() -> Column:
    """Tags of a link that does not lead to a web page: a download, or its address, clipped."""
    href = text.href(F.coalesce(attr("href"), F.lit("")))
    scheme = F.lower(F.substring_index(href, ":", 1))
    other = href.contains(":") & ~href.startswith(":") & ~href.startswith("/") & ~scheme.isin("http", "https")
    return F.array_compact(F.array(F.when(attr("download").isNotNull(), "download"), F.when(other, F.concat(F.lit("href="), text.clip(href, 50)))))


def progress_value() -> Column:
    """How far a progress bar or meter is: the page's own words in quotes, else the percent of
    its range, else, where the range is empty, the bare number; '' where the page says nothing.
    Native bars run from 0 to 1 unless they say otherwise, a ``progress`` always from 0; others
    from 0 to 100, and only their aria attributes count."""
    words = text.clean(F.coalesce(attr("aria-valuetext"), F.lit("")))
    native = F.col("tag").isin("progress", "meter")

    def number(name: str) -> Column:
        said = F.nullif(F.coalesce(attr(f"aria-value{'now' if name == 'value' else name}"), F.lit("")), F.lit(""))
        return F.trim(F.coalesce(said, F.when(native, attr(name)))).try_cast("double")

    now, said_lo, said_hi = number("value"), number("min"), number("max")
    lo = F.when(F.col("tag") == "progress", 0.0).otherwise(F.coalesce(said_lo, F.lit(0.0)))
    hi = F.when(native, F.coalesce(F.when(said_hi > lo, said_hi), F.lit(1.0))).otherwise(F.coalesce(said_hi, F.lit(100.0)))
    percent = F.floor(100 * F.least(F.greatest((now - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) + 0.5).cast("long").cast("string")
    bare = F.regexp_replace(now.cast("string"), r"\.0$", "")
    return F.when(words != "", text.quote(words, 60)).when(now.isNull(), "").when(hi > lo, F.concat(percent, F.lit("%"))).otherwise(bare)


def facts(nodes: DataFrame) -> DataFrame:
    """``nodes`` with role, level, hidden, disabled, interactive, checked, expanded and more.
    One hash exchange by page, in tasks of a size; all windows share it. ``clickable`` is a node without a role
    that reacts to clicks: a handler, a tab stop, or where a pointer cursor starts.

    What lies below, above and anywhere on the page is asked in one window each: every window
    copies its rows, and what a projection between two of them computes stays short enough
    to be compiled.
    """
    off = attr("disabled").isNotNull()
    below = {"_structured": tree.holds(_structure()), "_fields": tree.holds(F.col("tag").isin("button", "input", "select", "textarea"))}
    out = dealt(nodes, "page_id").withColumns(below).withColumns({"_tag_role": _tag_role(), "_own_hidden": hidden_by_itself()})
    out = out.withColumns({"hidden": F.col("_own_hidden") | tree.under(F.col("_own_hidden")), "_sectioned": tree.under(F.col("tag").isin("article", "aside", "main", "nav", "section"))})
    of_page = {
        "_editables": _among(_editable()),
        "_pointers": _among(_pointed()),
        "_details": _among(F.col("tag") == "details"),
        "_opened": _among((F.col("tag") == "details") & attr("open").isNotNull()),
        "_shut": _among((F.col("tag") == "fieldset") & off),
        "_groups": _among((F.col("tag") == "optgroup") & off),
        "_legends": _among(F.col("tag") == "legend", F.struct("parent", "node")),
    }
    said = lambda name: F.coalesce(attr(name) == "true", F.lit(False))
    current = F.coalesce(F.lower(F.trim(attr("aria-current"))), F.lit(""))
    opened, summed = (F.array_contains(c, F.col("parent")) for c in ("_opened", "_details"))
    own = {
        "selected": said("aria-selected") | ~current.isin("", "false") | (F.col("tag") == "option") & attr("selected").isNotNull(),
        "required": attr("required").isNotNull() | said("aria-required"),
        "invalid": said("aria-invalid"),
        "expanded": F.when(attr("aria-expanded").isin("true", "false"), attr("aria-expanded") == "true").when((F.col("tag") == "summary") & summed, opened),
        "pressed": said("aria-pressed"),
    }
    out = out.withColumns(of_page).withColumns({"role": role(), "_legends": _among(_first_legend()), **own})
    checked = F.coalesce(attr("aria-checked").isin("true", "mixed"), F.lit(False)) | (F.col("tag") == "input") & F.col("role").isin("checkbox", "radio") & attr("checked").isNotNull()
    out = out.withColumns({"level": level(), "disabled": disabled(), "checked": checked})
    tab = F.trim(F.coalesce(attr("tabindex"), F.lit("")))
    handed = (F.col("tag") == "label") & (attr("for").isNotNull() | F.col("_fields"))
    starts = _pointed() & ~F.coalesce(F.array_contains("_pointers", F.col("parent")), F.lit(False))
    reacts = attr("onclick").isNotNull() | starts | (tab != "") & ~tab.startswith("-")
    plain = (F.col("kind") == "element") & (F.col("role") == "") & ~F.col("tag").isin("html", "body") & ~F.col("hidden")
    return out.withColumns({"interactive": F.col("role").isin(*INTERACTIVE) & ~F.col("hidden"), "clickable": plain & ~handed & F.coalesce(reacts, F.lit(False))}).drop("_tag_role", "_own_hidden", "_sectioned", *below, *of_page)


def readable(facts_df: DataFrame) -> DataFrame:
    """Readable pieces in document order: visible text, alt text of images, and a space at each
    edge of a block."""
    aria = tree.under(F.coalesce(attr("aria-hidden") == "true", F.lit(False)))
    block = (F.col("kind") == "element") & ~F.col("tag").isin(*INLINE)
    out = facts_df.withColumn("_silent", aria | F.coalesce(attr("aria-hidden") == "true", F.lit(False)))
    out = out.withColumn("_edge", block)
    ends = out.where(F.col("_edge")).select("page_id", F.col("end").alias("node")).distinct().withColumn("_closes", F.lit(True))
    out = out.hint("merge").join(ends, ["page_id", "node"], "left")
    said = F.when(F.col("hidden") | F.col("_silent"), "").when(F.col("kind") == "text", F.col("text")).when(F.col("tag") == "img", F.coalesce(attr("alt"), F.lit(""))).otherwise("")
    piece = F.concat(F.when(F.col("_edge") | F.coalesce("_closes", F.lit(False)), " ").otherwise(""), said)
    return out.withColumn("piece", piece).where("piece <> ''").drop("_edge", "_closes", "_silent").hint("merge")


def spoken(facts_df: DataFrame) -> DataFrame:
    """(page_id, node, path, piece) of the readable pieces: what texts below roots are made of."""
    return readable(facts_df).select("page_id", "node", "path", "piece")


def page_text(readable_df: DataFrame) -> DataFrame:
    """(page_id, text): all readable pieces of a page as one clean line."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "piece"))), lambda x: x["piece"]), "")
    return readable_df.groupBy("page_id").agg(text.clean(joined).alias("text"))


def names(facts_df: DataFrame, readable_df: DataFrame | None = None) -> DataFrame:
    """(page_id, node, name, source) of elements with a role.

    Sources in order: aria-labelledby (of each named node its aria-label, else its text),
    aria-label, alt of areas, images and image buttons, value of buttons ("Submit" where a
    submit button has none), label of fields, a dialog's first heading, content, title, and
    placeholder of fields. Of repeated ids the first in the document counts. Texts below roots are
    read by five branches, so they are written once: planned anew in each, the driver would
    hold a plan that grows with branches times joins.
    """
    facts_df = facts_df.hint("merge")
    pieces = stored(spoken(facts_df), "pieces") if readable_df is None else readable_df
    heads = facts_df.where(F.col("role").isin("dialog", "alertdialog", "heading") & ~F.col("hidden")).withColumn("root", F.min(F.when(F.col("role") == "heading", F.col("node"))).over(tree.after()))
    titled = heads.where("role <> 'heading' and root < end").select("page_id", "node", "root")
    named = facts_df.where("role <> ''")
    content_roots = named.where(F.col("role").isin(*NAMED_BY_CONTENT)).select("page_id", F.col("node").alias("root"))
    first = Window.partitionBy("page_id", "id").orderBy("node")
    ids = facts_df.where(attr("id") != "").select("page_id", attr("id").alias("id"), "node", text.clean(F.coalesce(attr("aria-label"), F.lit(""))).alias("own")).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("page_id", "id", "node", "own")
    by = named.where(attr("aria-labelledby").isNotNull()).select("page_id", "node", F.posexplode(F.split(F.trim(attr("aria-labelledby")), r"\s+")).alias("at", "id"))
    by = by.join(ids.withColumnRenamed("node", "root"), ["page_id", "id"])
    labels = facts_df.where((F.col("tag") == "label") & ~F.col("hidden")).select("page_id", F.col("node").alias("root"), F.col("end").alias("_end"), attr("for").alias("id"))
    labelled = labels.where("id is not null").join(ids, ["page_id", "id"]).groupBy("page_id", "node").agg(F.min("root").alias("root"))
    roots = content_roots.unionByName(by.select("page_id", "root")).unionByName(labels.select("page_id", "root")).unionByName(titled.select("page_id", "root")).distinct()
    contents = stored(tree.text_of(pieces, roots).withColumn("content", text.clean(F.col("content"))), "contents")
    by_said = by.join(contents, ["page_id", "root"], "left").withColumn("said", F.coalesce(F.nullif("own", F.lit("")), "content", F.lit("")))
    by_text = by_said.groupBy("page_id", "node").agg(text.clean(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), " ")).alias("_by"))
    label_text = labelled.join(contents, ["page_id", "root"]).select("page_id", "node", F.col("content").alias("_label"))
    wrapping = named.where(F.col("tag").isin("input", "select", "textarea")).select("page_id", "node", F.explode("path").alias("root")).join(labels.select("page_id", "root"), ["page_id", "root"]).join(contents, ["page_id", "root"]).groupBy("page_id", "node").agg(F.max_by("content", "root").alias("_wrap"))
    heading_text = titled.join(contents, ["page_id", "root"]).select("page_id", "node", F.col("content").alias("_heading"))
    own = contents.withColumnsRenamed({"root": "node", "content": "_content"})
    out = named
    for more in (by_text, label_text, wrapping, heading_text, own):
        out = out.join(more.hint("merge"), ["page_id", "node"], "left")
    given = lambda c: F.nullif(text.clean(c), F.lit(""))
    kind = F.when(F.col("tag") == "input", F.lower(F.coalesce(attr("type"), F.lit(""))))
    pushed, field = kind.isin("button", "submit", "reset"), F.col("tag").isin("input", "select", "textarea")
    some = lambda c: F.nullif(c, F.lit(""))
    sources = {
        "labelledby": some(F.col("_by")),
        "aria-label": given(attr("aria-label")),
        "alt": F.when(F.col("tag").isin("img", "area") | (kind == "image"), given(attr("alt"))),
        "value": F.when(pushed, given(attr("value"))),
        "default": F.when(kind == "submit", F.lit("Submit")),
        "label": F.when(field & ~F.coalesce(pushed | (kind == "image"), F.lit(False)), some(F.coalesce("_label", "_wrap"))),
        "heading": some(F.col("_heading")),
        "content": F.when(F.col("role").isin(*NAMED_BY_CONTENT), some(F.col("_content"))),
        "title": given(attr("title")),
        "placeholder": F.when(field, given(attr("placeholder"))),
    }
    source = F.coalesce(*[F.when(c.isNotNull(), k) for k, c in sources.items()])
    return out.select("page_id", "node", F.coalesce(*sources.values(), F.lit("")).alias("name"), source.alias("source")).hint("merge")


def contradictions(facts_df: DataFrame) -> DataFrame:
    """Controls whose label differs from the words they show, or that have neither."""
    pieces = stored(spoken(facts_df), "pieces")
    n = stored(names(facts_df, pieces), "names")
    controls = facts_df.where("interactive").select("page_id", "node", "role")
    shown = tree.text_of(pieces, controls.withColumnRenamed("node", "root")).select("page_id", F.col("root").alias("node"), text.clean(F.col("content")).alias("shown"))
    out = controls.join(n, ["page_id", "node"]).join(shown, ["page_id", "node"], "left").withColumn("shown", F.coalesce("shown", F.lit("")))
    verdict = F.when(F.col("name") == "", "unlabelled").when(text.label_differs(F.col("name"), F.col("shown")), "differs")
    return out.withColumn("verdict", verdict).where("verdict is not null").select("page_id", "node", "role", "name", "shown", "verdict")
