"""What changed between two views of a page, and feeds of such changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity(ref: Column, label: Column, body: Column) -> Column:
    return F.when(ref != "", ref).otherwise(F.trim(F.concat_ws(" ", label, body)))


def tag_changes(old: Column, new: Column) -> Column:
    """`` +a -b`` for tags that came and went."""
    plus = F.transform(F.array_except(new, old), lambda t: F.concat(F.lit(" +"), t))
    minus = F.transform(F.array_except(old, new), lambda t: F.concat(F.lit(" -"), t))
    return F.concat(F.array_join(plus, ""), F.array_join(minus, ""))


def diff(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ("pair",)) -> DataFrame:
    """(by, op, pos, text): removed, added and changed lines of each pair.

    Lines have (by, pos, key, ref, label, body, tags, text). Keyed lines are matched by key,
    the first of a key alone counting on either side, and a move is no change; lines of key 0
    are a multiset of texts. Order is by op (removed, added, changed) and pos.
    """
    def keyed(df: DataFrame, side: str) -> DataFrame:
        first = Window.partitionBy(*by, "key").orderBy("pos")
        rows = df.where("key <> 0").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
        return rows.select(*by, "key", *[F.col(c).alias(f"{side}_{c}") for c in ("pos", "ref", "label", "body", "tags", "text")])

    both = keyed(old, "o").join(keyed(new, "n"), [*by, "key"], "full_outer")
    same = F.col("o_label").eqNullSafe(F.col("n_label")) & F.col("o_body").eqNullSafe(F.col("n_body"))
    op = F.when(F.col("n_pos").isNull(), "-").when(F.col("o_pos").isNull(), "+").when(~same | (F.col("o_tags") != F.col("n_tags")), "~")
    said = F.when(op == "-", identity(F.col("o_ref"), F.col("o_label"), F.col("o_body"))).when(same & (op == "~"), F.concat(identity(F.col("n_ref"), F.col("n_label"), F.col("n_body")), tag_changes(F.col("o_tags"), F.col("n_tags")))).otherwise(F.col("n_text"))
    by_key = both.withColumn("op", op).where("op is not null").select(*by, "op", F.when(F.col("op") == "-", F.col("o_pos")).otherwise(F.col("n_pos")).alias("pos"), said.alias("text"))
    counts = lambda df, c: df.where("key = 0").groupBy(*by, "text").agg(F.count("*").alias(c))
    balance = counts(old, "o").join(counts(new, "n"), [*by, "text"], "full_outer").select(*by, "text", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("n", F.lit(0)).alias("n")).where("o <> n")
    nth = Window.partitionBy(*by, "text").orderBy("pos")

    def surplus(df: DataFrame, op: str, more: str, less: str) -> DataFrame:
        rows = df.where("key = 0").select(*by, "pos", "text").withColumn("_k", F.row_number().over(nth))
        return rows.join(balance, [*by, "text"]).where(F.col("_k") <= F.col(more) - F.col(less)).select(*by, F.lit(op).alias("op"), "pos", "text")

    return by_key.unionByName(surplus(old, "-", "o", "n")).unionByName(surplus(new, "+", "n", "o"))


def order_of(op: Column) -> Column:
    return F.when(op == "-", 0).when(op == "+", 1).otherwise(2)


def fit_delta(delta: DataFrame, budget_tokens: int, by: tuple[str, ...] = ("pair",)) -> DataFrame:
    """``delta`` with (rank, kept, left_out): lines are kept while their bytes fit, counted with
    the mark and the line end; the first always is. 0 keeps all."""
    order = Window.partitionBy(*by).orderBy(order_of(F.col("op")), "pos", "text")
    used = F.sum(F.octet_length("text") + 3).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.row_number().over(order)
    # once a line is left out, all after it are
    kept = F.lit(True) if budget_tokens <= 0 else (rank == 1) | (used <= budget_tokens * 4)
    out = delta.withColumn("rank", rank.cast("long")).withColumn("kept", kept)
    return out.withColumn("left_out", F.sum((~F.col("kept")).cast("long")).over(Window.partitionBy(*by)))


def previous(captures: DataFrame, session: str = "session_id", order: str = "ts") -> DataFrame:
    """``captures`` (session, capture_id, document, ts) with previous capture, epoch and
    whether the document is new: a new document starts a new numbering epoch."""
    w = Window.partitionBy(session).orderBy(order, "capture_id")
    is_new = ~F.col("document").eqNullSafe(F.lag("document").over(w))
    out = captures.withColumn("prev_id", F.lag("capture_id").over(w)).withColumn("new_document", is_new | F.col("prev_id").isNull())
    return out.withColumn("epoch", F.sum(F.col("new_document").cast("long")).over(w))


def change_feed(captures: DataFrame, lines: DataFrame, session: str = "session_id", order: str = "ts") -> DataFrame:
    """(capture_id, op, pos, text): a new document is shown whole (op ``=``), else its delta
    against the view before it."""
    steps = previous(captures, session, order)
    whole = lines.join(steps.where("new_document").select("capture_id"), "capture_id").select("capture_id", F.lit("=").alias("op"), "pos", "text")
    pairs = steps.where("not new_document").select("capture_id", "prev_id")
    old = lines.withColumnRenamed("capture_id", "prev_id").join(pairs, "prev_id").drop("prev_id").withColumnRenamed("capture_id", "pair")
    new = lines.join(pairs.select("capture_id"), "capture_id").withColumnRenamed("capture_id", "pair")
    return whole.unionByName(diff(old, new).withColumnRenamed("pair", "capture_id"))


def stable_refs(sightings: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, epoch, kind, backend, number) of (session, epoch, kind, backend, seq, pos): a
    node keeps the number of its first sight, and numbers are never used again."""
    first = sightings.groupBy(session, "epoch", "kind", "backend").agg(F.min(F.struct("seq", "pos")).alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(session, "epoch", "kind").orderBy("first", "backend"))).drop("first")


def rebind(lost: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(by, ref, node, matches): lost refs bound to the one node of equal role, name, tag and
    stable attributes; several are told apart by position; else unbound with their count."""
    key = [*by, "role", "name", "tag", "stable"]
    found = nodes.select(*key, "node", F.col("position").alias("_position"), F.lit(1).alias("_met"))
    same = F.col("position") == F.col("_position")
    told = lost.join(found, key, "left").groupBy(*by, "ref").agg(F.count("_met").alias("matches"), F.count_if(same).alias("_sames"), F.max("node").alias("_one"), F.max(F.when(same, F.col("node"))).alias("_same"))
    bound = F.when(F.col("matches") == 1, F.col("_one")).when(F.col("_sames") == 1, F.col("_same"))
    return told.select(*by, "ref", bound.alias("node"), "matches")
