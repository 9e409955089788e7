"""Keyed state that ends with its session: maps and values with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NUMBERED = "session_id string, document string, epoch long, kind string, backend long, number long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(frames: Iterator[pd.DataFrame], by: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of a batch in order of ``by``: their time in milliseconds and ``columns``. Sessions
    are many and small, so what a frame costs counts more than what its rows do."""
    every = list(frames)
    rows = every[0] if len(every) == 1 else pd.concat(every)
    at = np.lexsort([rows[c].to_numpy() for c in reversed(by)])
    now = rows["ts"].to_numpy().astype("datetime64[ms]").astype("int64")[at].tolist()
    return zip(now, *(rows[c].iloc[at].tolist() if c == "ts" else rows[c].to_numpy()[at].tolist() for c in columns), strict=True)


class _Numbers(StatefulProcessor):
    """Numbers the nodes of a session as they are first seen, a map entry for each node."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "document string, epoch long, last long")
        self.counters = handle.getMapState("counters", "kind string", "n long")
        self.known = handle.getMapState("known", "kind string, backend long", "n long")

    def _forget(self) -> None:
        self.counters.clear()
        self.known.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The store is asked for a node once a batch, and only while the stored epoch goes on;
        what a batch forgets again is never written."""
        document, epoch, last = self.at.get() or (None, -1, None)
        stored = last is not None
        timers = list(self.handle.listTimers()) if stored else []
        counters = {k[0]: n[0] for k, n in self.counters.iterator()} if stored else {}
        known: set[tuple] = set()
        fresh: dict[tuple, int] = {}
        forget = False
        out = []
        for now, shown, kind, backend in _in_order(rows, ("ts", "seq", "pos"), ("document", "kind", "backend")):
            if last is None or now - last > self.idle_ms or shown != document:
                forget, stored = forget or stored, False
                document, epoch, counters, known, fresh = shown, epoch + 1, {}, set(), {}
            last = now
            node = (kind, backend)
            if node in known:
                continue
            known.add(node)
            if not (stored and self.known.containsKey(node)):
                fresh[node] = counters[kind] = counters.get(kind, 0) + 1
                out.append((key[0], document, epoch, kind, backend, counters[kind]))
        if forget:
            self._forget()
        for node, n in fresh.items():
            self.known.updateValue(node, (n,))
        for kind in {node[0] for node in fresh}:
            self.counters.updateValue((kind,), (counters[kind],))
        self.at.update((document, epoch, last))
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=["session_id", "document", "epoch", "kind", "backend", "number"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The session was idle: its nodes and counters go, its epoch stays."""
        self._forget()
        return iter([])

    def close(self) -> None:
        pass


def numbered_until_idle(sightings: DataFrame, idle: timedelta = timedelta(minutes=15), late: str = "10 minutes") -> DataFrame:
    """(session_id, document, epoch, kind, backend, number): nodes of a session numbered by kind
    as they are first seen, anew with each document and after each idle time.

    ``sightings`` has (session_id, document, kind, backend, seq, pos, ts). A node is one entry
    of the state store, which is read and written singly; when event time has passed a session
    by ``idle``, a timer drops all its entries but the epoch. Rows of one batch are taken in
    order of ts, seq, pos. The session must use the RocksDB state store.
    """
    rows = sightings.select("session_id", "document", "kind", "backend", "seq", "pos", "ts").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(_Numbers(int(idle.total_seconds() * 1000)), NUMBERED, "append", "EventTime")


ARRIVED = "session_id string, seq long, document string, kind string, text string, ts timestamp"
NOISE = ("console-error", "failed-fetch", "toast")


class _InForce(StatefulProcessor):
    """Keeps the document each session shows, and judges its events by it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "document string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shown = self.shown.get()[0] if self.shown.exists() else None
        out, last = [], 0
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            last = int(r.ts.timestamp() * 1000)
            if r.kind == "navigate":
                shown = r.document
                continue
            old = shown is not None and r.document != shown
            if not (old and r.kind in NOISE):
                text = f"on the previous page: {r.text}" if old and r.kind == "dialog" else r.text
                out.append((key[0], r.seq, r.document, r.kind, text, r.ts))
        if shown is not None:
            self.shown.update((shown,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=["session_id", "seq", "document", "kind", "text", "ts"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.shown.clear()
        return iter([])

    def close(self) -> None:
        pass


def arriving_in_force(events: DataFrame, idle: timedelta = timedelta(days=1), late: str = "10 minutes") -> DataFrame:
    """(session_id, seq, document, kind, text, ts): events of the document in force, which each
    ``navigate`` event of the same stream sets. Noise of the page being left goes, its dialogs
    are renamed; before the first navigation all stay. What a session shows is forgotten when
    event time has passed it by ``idle``. The session must use the RocksDB state store."""
    rows = events.select("session_id", "seq", "document", "kind", "text", "ts").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(_InForce(int(idle.total_seconds() * 1000)), ARRIVED, "append", "EventTime")


TOASTS = "session_id string, seq long, text string, ts timestamp"


class _Toasts(StatefulProcessor):
    """Candidates of each session: what was added since the last drain and stands in nothing
    else that was; and the texts told since then."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.candidates = handle.getMapState("candidates", "node long", "inside array<long>, text string")
        self.told = handle.getMapState("told", "text string", "seq long")

    def _drain(self) -> None:
        self.candidates.clear()
        self.told.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The store gives what it holds of the session once a batch and takes what has changed."""
        held = {k[0]: ([int(x) for x in v[0]] if v[0] is not None else [], v[1]) for k, v in self.candidates.iterator()}
        told = {k[0]: v[0] for k, v in self.told.iterator()}
        stored, stored_told = dict(held), set(told)
        out, last = [], 0
        for last, seq, what, node, inside, text, ts in _in_order(rows, ("ts", "seq"), ("seq", "what", "node", "inside", "text", "ts")):
            if what == "drain":
                held, told = {}, {}
            elif what == "add":
                above = [int(x) for x in inside] if inside is not None else []
                if not any(x in held for x in (int(node), *above)):
                    held[int(node)] = (above, text)
            elif what == "remove":
                gone = sorted((k, text) for k, (above, text) in held.items() if k == node or node in above)
                for k, text in gone:
                    del held[k]
                    if text and text not in told:
                        told[text] = int(seq)
                        out.append((key[0], seq, text, ts))
        for k in stored.keys() - held.keys():
            self.candidates.removeKey((k,))
        for k, v in held.items():
            if stored.get(k) != v:
                self.candidates.updateValue((k,), v)
        for text in stored_told - told.keys():
            self.told.removeKey((text,))
        for text in told.keys() - stored_told:
            self.told.updateValue((text,), (told[text],))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=["session_id", "seq", "text", "ts"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._drain()
        return iter([])

    def close(self) -> None:
        pass


def outermost_toasts(changes: DataFrame, idle: timedelta = timedelta(minutes=15), late: str = "10 minutes") -> DataFrame:
    """(session_id, seq, text, ts) of messages that came and went between two drains.

    ``changes`` (session_id, seq, what, node, inside, text, ts) are added and removed nodes,
    ``inside`` the nodes above, and drains. What is added inside a candidate is part of it, so
    nested messages give one row; a removed node takes along the candidates that it holds; a
    text is told once between drains, which forget all candidates. So does idle time.
    """
    rows = changes.select("session_id", "seq", "what", "node", "inside", "text", "ts").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(_Toasts(int(idle.total_seconds() * 1000)), TOASTS, "append", "EventTime")


MICROSECOND = timedelta(microseconds=1)
ENDED = "session_id string, opened timestamp, ended timestamp, why string, busy boolean"


class _Holders(StatefulProcessor):
    """Who holds a session and when it was last used, in microseconds; a timer ends it."""

    def __init__(self, idle: int, grace: int):
        self.idle, self.grace = idle, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "opened long, used long, released long")
        self.holders = handle.getMapState("holders", "holder string", "since long")
        self.requests = handle.getMapState("requests", "request string", "since long")

    def _due(self, at: tuple, held: bool, busy: bool) -> tuple[int, str] | None:
        """When the session ends if nothing more happens, and why; never while it is held or busy."""
        if held or busy:
            return None
        return (at[1] + self.idle, "idle") if at[2] is None else (max(at[1], at[2] + self.grace), "holder left")

    def _end(self, key: tuple, at: tuple, when: int, why: str, busy: bool) -> tuple:
        for state in (self.at, self.holders, self.requests):
            state.clear()
        return key[0], pd.Timestamp(at[0], unit="us"), pd.Timestamp(when, unit="us"), why, busy

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.at.get() if self.at.exists() else None
        at = None if at is None else tuple(at)
        holders = {k[0] for k, _ in self.holders.iterator()}
        requests = {k[0] for k, _ in self.requests.iterator()}
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            now = r.ts.value // 1000
            due = self._due(at, bool(holders), bool(requests)) if at else None
            if due and due[0] <= now:
                out.append(self._end(key, at, *due, False))
                at, holders, requests = None, set(), set()
            if r.what == "stop":
                if at:
                    out.append(self._end(key, at, now, "stopped", bool(requests)))
                at, holders, requests = None, set(), set()
                continue
            if r.what == "release" and r.who not in holders or r.what == "done" and r.who not in requests:
                continue
            opened, _, released = at or (now, now, None)
            if r.what == "hold":
                holders.add(r.who)
                self.holders.updateValue((r.who,), (now,))
                released = None
            elif r.what == "release":
                holders.discard(r.who)
                self.holders.removeKey((r.who,))
                released = None if holders else now
            elif r.what == "start":
                requests.add(r.who)
                self.requests.updateValue((r.who,), (now,))
            elif r.what == "done":
                requests.discard(r.who)
                self.requests.removeKey((r.who,))
            at = (opened, at[1] if at and r.what in ("hold", "release") else now, released)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at:
            self.at.update(at)
            due = self._due(at, bool(holders), bool(requests))
            if due:
                self.handle.registerTimer(-(-due[0] // 1000))
        yield pd.DataFrame(out, columns=["session_id", "opened", "ended", "why", "busy"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = tuple(self.at.get()) if self.at.exists() else None
        due = self._due(at, False, False) if at else None
        yield pd.DataFrame([self._end(key, at, *due, False)] if due else [], columns=["session_id", "opened", "ended", "why", "busy"])

    def close(self) -> None:
        pass


def ended_sessions(uses: DataFrame, idle: timedelta = timedelta(minutes=15), grace: timedelta = timedelta(seconds=10), late: str = "10 minutes") -> DataFrame:
    """(session_id, opened, ended, why, busy) of sessions that nobody needs any more.

    ``uses`` (session_id, seq, what, who, ts) are ``hold`` and ``release`` by a holder, ``start``
    and ``done`` of a request, any other use, and ``stop``. A session opens with its first use
    and ends, by event time, when it was stopped; ``grace`` after its last holder left, a
    request then running letting it live until that is done; or, never held, after ``idle``
    without use. What comes later opens it anew. Releases and ends of what was not begun are
    left out. State is one entry for each holder and running request, dropped with the session.
    The session must use the RocksDB state store.
    """
    rows = uses.select("session_id", "seq", "what", "who", "ts").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(_Holders(idle // MICROSECOND, grace // MICROSECOND), ENDED, "append", "EventTime")
