"""Prefix trie of conversations by collapsing whole sequences.

Identical conversations become one weighted sequence with the list of its ends; sequences
that are proper prefixes of others fall to an anti-join, which leaves the leaves; the nodes
are the weighted prefixes, added up. Turns are numbered and prefixes hashed by segments with
carried sums, so neither a long conversation nor many copies of one meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import finishing
from .workspace import arrow_rows, discard, materialize

SEGMENT = 1000
IDS_A_CHUNK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def _print60(column: Column) -> list[Column]:
    """Two 60-bit numbers from the SHA-256 of a string."""
    digest = F.sha2(column, 256)
    return [F.conv(F.substring(digest, a, 15), 16, 10).cast("long") for a in (1, 16)]


def numbered_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, part, p, x, chars): each turn's place p from 0, print and code points.

    Rows are sorted by range over all tasks, so a conversation of any length spreads; its
    places are counted in each part of the sort and start after the counts of the parts
    before. Only conversations that cross parts, fewer than there are parts, carry counts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    order = ["conv", "turn", "role", "text"]
    turns = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    x = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    stored = materialize(turns.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), x.alias("x"), F.char_length("text").cast("long").alias("chars")), "turns")
    parts = stored.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = F.broadcast(parts.withColumn("before", before).where("before > 0").drop("n"))
    here = F.row_number().over(Window.partitionBy("conv", "part").orderBy("at")) - 1
    return stored.withColumn("p", here).join(carried, ["conv", "part"], "left").select("conv", "part", (F.col("p") + F.coalesce("before", F.lit(0))).alias("p"), "x", "chars")


def rebuilt_turns(turns: DataFrame, *, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns (conv, d, x, chars), conversations (conv, depth)): conversation c begins with
    the first h = crc32(c) % ``heads`` turns of c - c % ``block``, all if that has fewer and
    none if it is absent; then follow its own turns after its first h. d counts from 1."""
    sizes = turns.groupBy("conv", "part").agg(F.count("*").alias("n"))
    convs = sizes.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", (F.crc32(F.col("conv").cast("string")) % heads).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % block)
    head = turns.where((F.col("p") < heads - 1) & (F.col("conv") % block == 0)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("p", "x", "chars"))).alias("head"))
    with_head = materialize(convs.join(head, "base", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, h)")).withColumn("k", F.size("head")).select("conv", "n", "h", "k", "head"), "heads")
    placed = sizes.select("conv", "part").join(with_head.select("conv", "h", "k"), "conv")
    own = turns.join(placed, ["conv", "part"]).where("p >= h").select("conv", (F.col("p") - F.col("h") + F.col("k") + 1).cast("long").alias("d"), "x", "chars")
    borrowed = with_head.select("conv", F.explode("head").alias("t")).select("conv", (F.col("t.p") + 1).cast("long").alias("d"), "t.x", "t.chars")
    depth = (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long")
    return own.unionByName(borrowed), with_head.select("conv", depth.alias("depth"))


def _segment() -> Column:
    return F.floor((F.col("d") - 1) / SEGMENT)


def _folded(rows: DataFrame, values: list[str], fold: Callable, join: Callable, later: bool) -> DataFrame:
    """``rows`` (conv, d, ...) with each value folded over the conversation's rows up to d, or
    from d on: within segments of 1000 turns, then what the segments before carry."""
    rows = rows.withColumn("seg", _segment())
    sums = rows.groupBy("conv", "seg").agg(*[fold(v).alias(v) for v in values])
    across = Window.partitionBy("conv").orderBy(F.col("seg").desc() if later else F.col("seg")).rowsBetween(Window.unboundedPreceding, -1)
    carries = sums.select("conv", "seg", *[fold(v).over(across).alias(f"_{v}") for v in values]).where(F.col(f"_{values[0]}").isNotNull())
    within = Window.partitionBy("conv", "seg").orderBy(F.col("d").desc() if later else F.col("d")).rowsBetween(Window.unboundedPreceding, 0)
    folded = rows.withColumns({v: fold(v).over(within) for v in values}).join(carries, ["conv", "seg"], "left")
    return folded.withColumns({v: join(F.col(v), F.coalesce(f"_{v}", F.lit(0))) for v in values}).drop("seg", *[f"_{v}" for v in values])


def prefix_prints(turns: DataFrame) -> DataFrame:
    """``turns`` with (a, b), the print of the first d turns, and (pa, pb), that of one fewer.
    A print is the exclusive or of 120 bits of SHA-256 of each turn and its place."""
    y1, y2 = _print60(F.concat(F.col("d").cast("string"), F.lit(":"), "x"))
    rows = turns.select("conv", "d", "chars", y1.alias("y1"), y2.alias("y2")).withColumns({"a": F.col("y1"), "b": F.col("y2")})
    rows = _folded(rows, ["a", "b"], F.bit_xor, lambda x, y: x.bitwiseXOR(y), later=False)
    return rows.select("conv", "d", "chars", "a", "b", F.col("a").bitwiseXOR(F.col("y1")).alias("pa"), F.col("b").bitwiseXOR(F.col("y2")).alias("pb"))


def end_digests(ends: DataFrame, most: int = IDS_A_CHUNK) -> DataFrame:
    """(depth, a, b, ends_sha256) from (depth, a, b, conv): SHA-256 of each sequence's decimal
    ids, ascending and comma-joined. A range sort deals the ids of any number of copies to
    all tasks, which join ``most`` of them at a time; a digest then reads only these chunks, one
    after another, as its definition demands, and holds one."""
    by = ["depth", "a", "b"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in finishing(batches):
            out = []
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key or len(ids) == most:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = now, []
                ids.append(conv)
            yield _table(out, [*by, "first", "ids"], [pa.int64()] * 4 + [pa.string()])
        if ids:
            yield _table([(*key, ids[0], ",".join(map(str, ids)))], [*by, "first", "ids"], [pa.int64()] * 4 + [pa.string()])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in finishing(batches):
            out = []
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _table(out, [*by, "ends_sha256"], [pa.int64()] * 3 + [pa.string()])
        if key is not None:
            yield _table([(*key, state.hexdigest())], [*by, "ends_sha256"], [pa.int64()] * 3 + [pa.string()])

    packed = ends.select(*by, "conv").repartitionByRange(*by, "conv").sortWithinPartitions(*by, "conv").mapInArrow(chunks, "depth long, a long, b long, first long, ids string")
    return packed.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(digests, "depth long, a long, b long, ends_sha256 string")


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` (depth, a, b, pa, pb, conv_id ...) with ``n_children`` and ``parent_conv_id``.
    Parents of more than a thousandth of all nodes, so fewer than a thousand, are broadcast;
    all others meet their children in a shuffle."""
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    counted = materialize(nodes.join(children, ["depth", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    total = counted.count()
    parents = counted.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") * 1000 > total
    key = ["depth", "pa", "pb"]
    some = counted.join(F.broadcast(parents.where(hot).drop("n_children").withColumnRenamed("parent_conv_id", "hot_conv_id")), key, "left")
    found = some.where("hot_conv_id is not null").withColumnRenamed("hot_conv_id", "parent_conv_id")
    rest = some.where("hot_conv_id is null").drop("hot_conv_id").join(parents.where(~hot).drop("n_children"), key, "left")
    return found.unionByName(rest)


def _by_segment(sequences: DataFrame) -> DataFrame:
    """A row for each segment of each sequence, to meet prefixes by (conv, seg)."""
    return sequences.where("depth > 0").withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("depth") - 1) / SEGMENT))))


def _prefixes(prints: DataFrame, sequences: DataFrame) -> DataFrame:
    """(conv, d, a, b, pa, pb, chars, depth, weight): all prefixes of the distinct sequences,
    the empty one included, under the smallest conversation of each sequence."""
    of = _by_segment(sequences.select("conv", "depth", "weight"))
    rows = prints.withColumn("seg", _segment()).join(of, ["conv", "seg"]).drop("seg")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = sequences.select("conv", zero.alias("d"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("chars"), "depth", "weight")
    return rows.select(*roots.columns).unionByName(roots)


def _nodes(prefixes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(depth, a, b, pa, pb, conv_id, n_convs, n_leaves, chars): weighted prefixes added up."""
    counts = prefixes.groupBy("d", "a", "b").agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    inside = prefixes.where("d > 0").withColumn("seg", _segment()).join(_by_segment(leaves.select("conv", "depth")).select("conv", "seg"), ["conv", "seg"]).groupBy("d", "a", "b").agg(F.count("*").alias("n"))
    roots = leaves.agg(F.count("*").alias("n")).select(*[F.lit(0).cast("long").alias(c) for c in ("d", "a", "b")], "n")
    return counts.join(inside.unionByName(roots), ["d", "a", "b"], "left").withColumn("n_leaves", F.coalesce("n", F.lit(0))).drop("n").withColumnRenamed("d", "depth")


def _saved(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, a, b, saved_tokens): each sequence sums what its owned nodes save from every
    depth on; a node adds up the sequences through it."""
    own = nodes.select(F.col("conv_id").alias("conv"), F.col("depth").alias("d"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"))
    rows = prefixes.select("conv", "d", "a", "b").join(own, ["conv", "d"], "left").withColumn("saves", F.coalesce("saves", F.lit(0).cast("long")))
    rows = _folded(rows, ["saves"], F.sum, lambda x, y: x + y, later=True)
    return rows.groupBy(F.col("d").alias("depth"), "a", "b").agg(F.sum("saves").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 100, heads: int = 6) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns are ordered by turn (null first); turns of equal number by role, then by text, and
    rows that repeat are turns of their own. Null roles and texts are empty; rows of null id
    take no part; columns besides these four play none. A conversation whose rebuilding
    leaves no turn is a member of the root alone. An empty table gives no rows.

    A conversation that owns a node, being its smallest member, owns all that follow on its
    own path. So what a node's subtree saves is, over the sequences through the node, the sum
    of what their owned nodes from its depth on save: one more sum over weighted prefixes.
    """
    arrow_rows(conversations.sparkSession)
    turns = materialize(numbered_turns(conversations, id_col, turn_col, role_col, text_col), "places")
    rebuilt, convs = rebuilt_turns(turns, block=block, heads=heads)
    prints = materialize(prefix_prints(rebuilt), "prefixes")
    whole = convs.join(prints.select("conv", F.col("d").alias("depth"), "a", "b"), ["conv", "depth"], "left")
    ends = materialize(whole.select("conv", "depth", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), "ends")
    sequences = materialize(ends.groupBy("depth", "a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("weight")), "sequences")
    prefixes = materialize(_prefixes(prints, sequences), "weighted")
    discard(turns)
    discard(prints)
    longer = prefixes.where("d < depth").select(F.col("d").alias("depth"), "a", "b").distinct()
    leaves = sequences.join(longer, ["depth", "a", "b"], "left_anti")
    nodes = materialize(_nodes(prefixes, leaves), "nodes")
    saved = _saved(prefixes, nodes)
    named = with_parents(nodes.join(saved, ["depth", "a", "b"]))
    digests = end_digests(ends)
    out = named.join(digests, ["depth", "a", "b"], "left")
    return out.select(F.col("conv_id").alias(id_col), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
