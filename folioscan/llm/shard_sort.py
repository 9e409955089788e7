"""Sharding by histogram sort: exact byte counts below key boundaries, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import discard, fresh, materialize

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _position(h: np.ndarray, i: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted probes are at or below each key (h, i)."""
    ph = np.array([p[0] for p in probes], np.int64)
    at = np.searchsorted(ph, h, "left")
    tied = np.flatnonzero(np.searchsorted(ph, h, "right") > at)
    for value in np.unique(h[tied]):
        rows = tied[h[tied] == value]
        at[rows] += np.searchsorted(np.array([b for a, b in probes if a == value], np.int64), i[rows], "right")
    return at


def _bytes_by_gap(keys: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(bytes, rows) of each gap between probes, the first gap lying below all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = _position(b.column(0).to_numpy(), b.column(1).to_numpy(), probes)
            np.add.at(size, at, b.column(2).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], ["gap", "size", "n"])

    out = [(0, 0)] * (len(probes) + 1)
    for r in keys.mapInArrow(count, "gap long, size long, n long").groupBy("gap").agg(F.sum("size"), F.sum("n")).collect():
        out[r[0]] = (r[1], r[2])
    return out


def _between(a: tuple[int, int], b: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n keys strictly between two keys, evenly spread in the coordinate that differs."""
    if b[0] - a[0] > 1:
        step = b[0] - a[0]
        return sorted({(a[0] + step * k // (n + 1), LEAST) for k in range(1, n + 1)} - {a, b})
    if a[0] != b[0]:  # the next value of h, then ids below it
        middle = (b[0], LEAST)
        if middle != b and middle > a:
            return [middle]
        b = (a[0], MOST + 1)
    step = b[1] - a[1]
    return sorted({(a[0], min(MOST, a[1] + step * k // (n + 1))) for k in range(1, n + 1)} - {a, b})


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 48, parts: int = 1) -> list[tuple[tuple[int, int], int]]:
    """(key, rows below it) for each boundary: shard k // parts begins at boundary k - 1.

    ``keys`` has (h long, i long, size long). Each round counts the exact bytes and rows below
    ``probes`` keys inside each open interval; only counts, at most boundaries * probes rows,
    come to the driver. A boundary is settled once the bytes below it lie within ``tolerance``
    (a share of one shard's bytes) of its target, or no key lies between its bounds: then it is
    the smallest key with at least that many bytes below. Every round divides an interval by
    ``probes`` + 1, so the rounds end. The boundaries between the ``parts`` of a shard, which
    only deal out work, settle within a quarter of a part. An empty table has none.
    """
    total, rows, least_h, most_h, least_i, most_i = keys.agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h"), F.min("i"), F.max("i")).first()
    if not total:
        return []
    low, high = (least_h, least_i), (most_h, min(MOST, most_i + 1))
    goals = {k: k * total / (shards * parts) for k in range(1, shards * parts)}
    slack = {k: tolerance * total / shards if k % parts == 0 else 0.25 * total / (shards * parts) for k in goals}
    open_ = {k: (low, (0, 0), high, (total, rows)) for k in goals}
    done: dict[int, tuple[tuple[int, int], int]] = {}
    while open_:
        asked = sorted({p for a, _, b, _ in set(open_.values()) for p in _between(a, b, probes)})
        gaps = np.array(_bytes_by_gap(keys, asked), np.int64) if asked else np.zeros((1, 2), np.int64)
        below = np.cumsum(gaps, axis=0)[:-1]
        for k, (a, at_a, b, at_b) in list(open_.items()):
            j = int(np.searchsorted(below[:, 0], goals[k], "left"))  # the first probe that reaches the goal
            if j < len(asked) and a < asked[j] < b:
                b, at_b = asked[j], tuple(below[j].tolist())
            if j and a < asked[j - 1] < b:
                a, at_a = asked[j - 1], tuple(below[j - 1].tolist())
            off, near, n = min((abs(n[0] - goals[k]), p, n[1]) for n, p in ((at_a, a), (at_b, b)))
            if slack[k] and off <= slack[k]:
                done[k] = near, n
            elif at_a == at_b or not _between(a, b, 1):
                done[k] = b, at_b[1]
            else:
                open_[k] = (a, at_a, b, at_b)
                continue
            del open_[k]
    out: list[tuple[tuple[int, int], int]] = []
    for k in sorted(done):  # a part's boundary stays between those of its shard
        last = done.get(-(-k // parts) * parts, ((MOST, MOST), rows))
        out.append(max(out[-1] if out else (low, 0), min(done[k], last)))
    return out


def shard_documents(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, keep_columns: bool = True) -> DataFrame:
    """``docs`` with size, shard and slot, dealt out so that shards hold near equal bytes.

    The key is (hash of the text, id): equal texts lie side by side, so a group of copies
    is cut only where a boundary falls inside it, and no group is too large for a shard.
    Size is the text's UTF-8 bytes plus 16. A null text counts as no bytes; a null id sorts
    first; rows equal in id and text go together; an empty table gives no rows; columns
    named like the new ones are replaced. slot numbers a shard's rows from 0 without gaps:
    a shard is numbered by parts, as many in all as there are shuffle partitions, each from
    the exact count of rows before it, so no task meets a whole shard.
    """
    h, i, part = fresh(docs, "h"), fresh(docs, "i"), fresh(docs, "part")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumns({"size": (F.octet_length(text) + 16).cast("long"), h: F.xxhash64(text), i: F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))})
    keys = materialize(sized.select(F.col(h).alias("h"), F.col(i).alias("i"), "size"), "keys")
    parts = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    found = splitters(keys, shards, tolerance, parts=parts)
    discard(keys)
    bounds = [((LEAST, LEAST), 0), *found]

    def at_or_above(a: int, b: int) -> Column:
        return (F.col(h) > a) | ((F.col(h) == a) & (F.col(i) >= b))

    if not keep_columns:
        sized = sized.select(F.col(id_col), "size", F.crc32(text).alias("text_crc32"), h, i)
    shard = sum((at_or_above(*k).cast("int") for k, _ in bounds[parts::parts]), F.lit(0))
    inner = [[F.struct(F.lit(k[0]).alias("h"), F.lit(k[1]).alias("i")) for k, _ in bounds[x + 1 : x + parts]] for x in range(0, len(bounds), parts)]
    first = [n for _, n in bounds]
    placed = sized.withColumn("shard", shard.cast("int"))
    if parts > 1 and found:
        own = F.element_at(F.array(*[F.array(*x) for x in inner]), F.col("shard") + 1)
        placed = placed.withColumn(part, F.size(F.filter(own, lambda k: (F.col(h) > k["h"]) | ((F.col(h) == k["h"]) & (F.col(i) >= k["i"])))))
    else:
        placed = placed.withColumn(part, F.lit(0))
    before = F.element_at(F.array(*[F.lit(n - first[x // parts * parts]).cast("long") for x, n in enumerate(first)]), F.col("shard") * parts + F.col(part) + 1)
    order = Window.partitionBy("shard", part).orderBy(h, i)
    return placed.withColumn("slot", F.row_number().over(order) - 1 + before).drop(h, i, part)
