"""HTML rows to node rows: one row for each element, text and comment, in document order."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements without content, and start tags that end open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "optgroup": ("select",), "tbody": ("table",), "tfoot": ("table",)}

# Elements that stand in a line of text.
INLINE = ("a", "abbr", "b", "bdi", "bdo", "button", "cite", "code", "data", "em", "i", "img", "input", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr")
_INLINE = frozenset(INLINE) | {"br"}

SCHEMA = "node int, parent int, end int, depth int, path array<int>, kind string, tag string, text string, attrs map<string,string>, block int, lists int"
_NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32()]


class _Tree(HTMLParser):
    """Collects (parent, kind, tag, text, attrs) and subtree ends; unclosed elements are implied."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[-1, "document", "", "", {}]]
        self.ends = [0]
        self.open = [0]

    def _add(self, kind: str, tag: str, text: str, attrs: dict) -> int:
        self.rows.append([self.open[-1], kind, tag, text, attrs])
        self.ends.append(0)
        return len(self.rows) - 1

    def _close(self, depth: int) -> None:
        for n in self.open[depth:]:
            self.ends[n] = len(self.rows)
        del self.open[depth:]

    def _close_any(self, tags: tuple[str, ...] | frozenset, scope: tuple[str, ...]) -> None:
        for d in range(len(self.open) - 1, 0, -1):
            tag = self.rows[self.open[d]][2]
            if tag in tags:
                return self._close(d)
            if tag in scope:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in P_ENDERS:
            self._close_any(("p",), ("table", "button", "td", "th"))
        if tag in IMPLIED:
            for _ in range(3):
                self._close_any(IMPLIED[tag], SCOPES[tag])
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        n = self._add("element", tag, "", first)
        if tag in VOID:
            self.ends[n] = len(self.rows)
        else:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        for d in range(len(self.open) - 1, 0, -1):
            if self.rows[self.open[d]][2] == tag:
                return self._close(d)
        return None

    def handle_data(self, data: str) -> None:
        self._add("text", "", data, {})
        self.ends[-1] = len(self.rows)

    def handle_comment(self, data: str) -> None:
        self._add("other", "", data, {})
        self.ends[-1] = len(self.rows)


def tree_of(html: str | None) -> list[tuple]:
    t = _Tree()
    t.feed(html or "")
    t.close()
    t._close(0)
    paths: list[list[int]] = []
    blocks: list[int] = []
    lists: list[int] = []
    out = []
    for n, (parent, kind, tag, text, attrs) in enumerate(t.rows):
        above = "" if parent < 0 else t.rows[parent][2]
        paths.append([] if parent < 0 else [*paths[parent], parent])
        blocks.append(0 if parent <= 0 else blocks[parent] if above in _INLINE else parent)
        lists.append(0 if parent < 0 else lists[parent] + (above in ("ul", "ol")))
        out.append((n, None if parent < 0 else parent, t.ends[n], len(paths[n]), paths[n], kind, tag, text, list(attrs.items()), blocks[n], lists[n]))
    return out


def nodes(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, node, parent, end, depth, path, kind, tag, text, attrs, block, lists) of every page.

    ``end`` is the exclusive end of a node's subtree, ``path`` its ancestors from the root,
    ``block`` the nearest ancestor that breaks lines and ``lists`` how many lists are above.
    No shuffle: a page's rows stay where the page was read. Null HTML is a document without
    children; broken markup is closed as a browser would in the common cases.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held = [], []
            for at, html in enumerate(b.column(1).to_pylist()):
                rows = tree_of(html)
                held += rows
                ids += [at] * len(rows)
                if len(held) > 20_000:
                    yield _packed(b.column(0), ids, held)
                    ids, held = [], []
            if held:
                yield _packed(b.column(0), ids, held)

    def _packed(keys: pa.Array, ids: list[int], rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(ids)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True))], [id_col, *_NAMES])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(html_col)).mapInArrow(go, f"{id_col} {kind}, {SCHEMA}")
