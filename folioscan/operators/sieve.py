"""A fixed-size filter of join keys, to drop rows before they are exploded or shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 19


def _at(*key: Column) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64(*key), F.lit(SLOTS))
    return F.shiftright(slot, 6).cast("int"), (slot % 64).cast("int")


def sieve(rows: DataFrame, *key: str) -> Callable[..., Column]:
    """A test of columns, of the types of ``key``, that holds for every key of ``rows`` and for
    few others. It is a map of SLOTS bits (64 KB) however many rows there are, so a join on the
    key must follow; past some SLOTS keys it lets most through."""
    word, bit = _at(*[F.col(k) for k in key])
    found = rows.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b")).collect()  # SLOTS / 64 rows at most
    held = {r.w: r.b for r in found}
    words = F.split(F.lit(",".join(str(held.get(k, 0)) for k in range(SLOTS // 64))), ",").cast("array<bigint>")

    def test(*values: Column) -> Column:
        word, bit = _at(*values)
        return F.getbit(F.get(words, word), bit) == 1

    return test if held else lambda *_: F.lit(False)
