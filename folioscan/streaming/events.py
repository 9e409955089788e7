"""Session streams: request folding, event counts, bursts, toasts, refusals, stable refs, kept state.

Each takes and returns a streaming DataFrame; ``late`` bounds how long state waits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscan.operators import netlog, state


def fold_requests(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each request so far, as ``netlog.fold_requests``; update or complete mode."""
    return netlog.fold_requests(events.withWatermark("ts", late))


def pending(requests: DataFrame, now: str, limit: str = "5 seconds") -> DataFrame:
    """Requests sent within ``limit`` of ``now`` without an answer."""
    return requests.where(F.col("status").isNull() & (F.col("ts") > F.to_timestamp(F.lit(now)) - F.expr(f"interval {limit}")))


def drain_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Repeats counted in tumbling windows."""
    return netlog.drain_windows(events.withWatermark("ts", late), width)


def settled(events: DataFrame, late: str = "10 seconds", gap: Column | None = None) -> DataFrame:
    """Activity bursts whose quiet gap depends on the kind of their events."""
    return netlog.bursts(events.withWatermark("ts", late), netlog.settle_gap(F.col("kind")) if gap is None else gap)


def bursts(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return netlog.bursts(events.withWatermark("ts", late), gap)


def session_ends(events: DataFrame, idle: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Visits that end after ``idle`` without use."""
    return netlog.bursts(events.withWatermark("ts", late), idle)


def arriving(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Events of the page in force: noise of the page being left goes, its dialogs are renamed.
    ``documents`` (session_id, document) is the static table of pages in force."""
    joined = events.join(documents.withColumnRenamed("document", "_now"), "session_id", "left")
    old = F.col("_now").isNotNull() & (F.col("document") != F.col("_now"))
    kept = joined.where(~(old & F.col("kind").isin("console-error", "failed-fetch", "toast")))
    return kept.withColumn("text", F.when(old & (F.col("kind") == "dialog"), F.concat(F.lit("on the previous page: "), "text")).otherwise(F.col("text"))).drop("_now")


def toasts(added: DataFrame, removed: DataFrame, within: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(session_id, node, text, ts) of elements added and removed within the interval."""
    a, r = added.withWatermark("ts", late).alias("a"), removed.withWatermark("ts", late).alias("r")
    on = (F.col("a.session_id") == F.col("r.session_id")) & (F.col("a.node") == F.col("r.node")) & (F.col("r.ts") >= F.col("a.ts")) & (F.col("r.ts") <= F.col("a.ts") + F.expr(f"interval {within}"))
    return a.join(r, on).select("a.session_id", "a.node", "a.text", "a.ts")


def once_per_document(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A refusal or challenge is told once for each document."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "document"])


def stable_refs(sightings: DataFrame) -> DataFrame:
    """(session_id, kind, backend, number) as nodes are first seen; numbers are not reused.

    State holds a session's counters and known nodes, and starts anew with a new document.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        document, counters, known = json.loads(held.get[0]) if held.exists else ["", {}, []]
        seen = set(known)
        rows = pd.concat(list(frames)).sort_values(["seq", "pos"])
        out = []
        for r in rows.itertuples():
            if r.document != document:
                document, counters, seen = r.document, {}, set()
            name = f"{r.kind}\x1f{r.backend}"
            if name not in seen:
                seen.add(name)
                counters[r.kind] = counters.get(r.kind, 0) + 1
                out.append((key[0], r.document, r.kind, r.backend, counters[r.kind]))
        held.update((json.dumps([document, counters, sorted(seen)]),))
        yield pd.DataFrame(out, columns=["session_id", "document", "kind", "backend", "number"])

    return sightings.groupBy("session_id").applyInPandasWithState(step, "session_id string, document string, kind string, backend long, number long", "held string", "append", GroupStateTimeout.NoTimeout)


def change_feed(views: DataFrame) -> DataFrame:
    """(session_id, capture_id, op, text, n): what each view of (session_id, capture_id, seq,
    document, lines) changed: ``=`` for the lines of a new document, else ``+`` and ``-`` by how
    often a line came or went.

    State is the last view of a session, which the next one replaces. Views of one batch are
    taken in order of seq.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        document, before = json.loads(held.get[0]) if held.exists else [None, {}]
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            now: dict[str, int] = {}
            for line in r.lines:
                now[line] = now.get(line, 0) + 1
            if r.document != document:
                out += [(key[0], r.capture_id, "=", line, n) for line, n in now.items()]
            else:
                moved = {line: now.get(line, 0) - before.get(line, 0) for line in {**before, **now}}
                out += [(key[0], r.capture_id, "+" if n > 0 else "-", line, abs(n)) for line, n in moved.items() if n]
            document, before = r.document, now
        held.update((json.dumps([document, before]),))
        yield pd.DataFrame(out, columns=["session_id", "capture_id", "op", "text", "n"])

    return views.groupBy("session_id").applyInPandasWithState(step, "session_id long, capture_id string, op string, text string, n long", "held string", "append", GroupStateTimeout.NoTimeout)


def keep_state(seen: DataFrame, read, write, most: int = state.MOST_SITES):
    """A foreachBatch writer: upserts a batch of (name, origin, items, seen) into the kept table.

    ``read(n)`` gives the table before batch n and ``write(df, changed, n)`` keeps it for what
    follows, so a batch that is run again starts from the same table. Of several rows of one
    site in a batch the last seen counts.
    """

    def put(batch: DataFrame, n: int) -> None:
        before = read(n)
        last = batch.groupBy("name", "origin").agg(F.max_by("items", "seen").alias("items"), F.max("seen").alias("seen"))
        after = state.newest_sites(state.upsert_storage(before, last), most)
        write(after, state.changed_names(before, after), n)

    return seen.writeStream.foreachBatch(put)
