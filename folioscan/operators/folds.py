"""State carried along rows in order: what neither a window nor a join can say.

Rows of a page or capture are dealt to one task, sorted there, and streamed; only the state
is held, never the group. In document order a stack of the open nodes is such a state, so a
value can be handed down from parents to children, or gathered up when a node ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _parsed(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _added(batch: pa.RecordBatch, rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    new = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)]
    return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *out.names])


def scan(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], inputs: tuple[str, ...], start: Callable[[], Any], step: Callable, out: str) -> DataFrame:
    """``df`` with the columns ``out``: ``step(state, *inputs)`` gives the next state and their
    values, row after row in ``order``, from ``start()`` on for each ``by``."""
    added = _parsed(out)
    arrow = to_arrow_schema(added)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in by), strict=True)
            values = zip(*(b.column(c).to_pylist() for c in inputs), strict=True)
            rows = []
            for now, x in zip(keys, values, strict=True):
                if now != key:
                    key, state = now, start()
                state, y = step(state, *x)
                rows.append(y)
            yield _added(b, rows, arrow)

    dealt = df.repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(go, StructType(df.schema.fields + added.fields))


def handed_down(df: DataFrame, by: tuple[str, ...], inputs: tuple[str, ...], top: Any, hand: Callable, out: str) -> DataFrame:
    """``df`` (node, end) with the columns ``out``: ``hand(above, *inputs)`` gives what a node's
    children get from it and its own values; roots get ``top``."""

    def step(stack: list, node: int, end: int, *x: Any) -> tuple[list, tuple]:
        while stack and stack[-1][0] <= node:
            stack.pop()
        below, values = hand(stack[-1][1] if stack else top, *x)
        if end > node + 1:
            stack.append((end, below))
        return stack, values

    return scan(df, by, ("node",), ("node", "end", *inputs), list, step, out)


def gathered(df: DataFrame, by: tuple[str, ...], inputs: tuple[str, ...], close: Callable, out: str) -> DataFrame:
    """(by, out): ``close(inputs, kids)`` is called when a node ends, with what its children
    gave in document order, and gives what its parent gets and the rows to put out. ``df`` has
    (node, parent); a parent that comes later, or none, makes a root."""
    added = _parsed(out)
    arrow = to_arrow_schema(added)
    schema = StructType([df.schema[c] for c in by] + added.fields)
    keys_arrow = to_arrow_schema(StructType([df.schema[c] for c in by]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack, held = None, [], []

        def shut(to: int) -> None:
            while len(stack) > to:
                _, x, kids = stack.pop()
                value, rows = close(x, kids)
                held.extend((*key, *r) for r in rows)
                if stack:
                    stack[-1][2].append(value)

        def poured() -> pa.RecordBatch:
            fields = [*keys_arrow, *arrow]
            out_batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(fields)], [f.name for f in fields])
            held.clear()
            return out_batch

        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in by), strict=True)
            values = zip(*(b.column(c).to_pylist() for c in ("node", "parent", *inputs)), strict=True)
            for now, (node, parent, *x) in zip(keys, values, strict=True):
                if now != key:
                    shut(0)
                    key = now
                at = len(stack)
                while at and stack[at - 1][0] != parent:
                    at -= 1
                shut(at)
                stack.append((node, x, []))
            if len(held) > 20_000:
                yield poured()
        shut(0)
        yield poured()

    return df.select(*by, "node", "parent", *inputs).repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(go, schema)


def intervals(df: DataFrame, by: tuple[str, ...] = ("capture_id",)) -> DataFrame:
    """(by, node, end) from (node, parent): where each node's subtree ends."""

    def close(x: list, kids: list) -> tuple[int, list]:
        end = kids[-1] if kids else x[0] + 1
        return end, [(x[0], end)]

    return gathered(df.withColumn("_at", F.col("node")), by, ("_at",), close, "node int, end int")
