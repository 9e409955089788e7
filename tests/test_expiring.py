"""Keyed state that ends with its session."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from folioscan.streaming import expiring

SCHEMA = "session_id string, document string, kind string, backend long, seq long, pos int, ts timestamp"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, expiring.STORE)
    yield spark
    spark.conf.set(name, before)


def test_state_shrinks_when_sessions_go_idle(rocks, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    batches = [
        [("a", "d", "link", k, k, 0, at(0)) for k in range(50)] + [("b", "d", "link", 1, 0, 0, at(1)), ("b", "d", "link", 2, 1, 0, at(2)), ("b", "e", "link", 2, 2, 0, at(3)), ("b", "e", "link", 3, 3, 0, at(30))],
        [("c", "d", "link", 1, 9, 0, at(100))],
        [("c", "d", "button", 1, 10, 0, at(101)), ("a", "d", "link", 7, 11, 0, at(102))],
        [("c", "d", "link", 1, 12, 0, at(103)), ("c", "d", "link", 5, 13, 0, at(103))],
    ]
    for k, rows in enumerate(batches):
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = expiring.numbered_until_idle(stream)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(100)
    rows = {(r.session_id, r.epoch, r.kind, r.backend): r.number for r in rocks.read.parquet(str(tmp_path / "out")).collect()}
    assert {k[3]: n for k, n in rows.items() if k[:2] == ("a", 0)} == {k: k + 1 for k in range(50)}
    assert rows["a", 1, "link", 7] == 1  # numbered anew after the idle time
    assert (rows["b", 0, "link", 2], rows["b", 1, "link", 2], rows["b", 2, "link", 3]) == (2, 1, 1)
    assert (rows["c", 0, "link", 1], rows["c", 0, "button", 1], rows["c", 0, "link", 5]) == (1, 1, 2)
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(totals) > 50 > 20 > totals[-1]


USES = "session_id string, seq long, what string, who string, ts timestamp"


def test_sessions_end_after_their_last_holder(rocks, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda seconds: start + timedelta(seconds=seconds)
    batches = [
        [("held", 0, "hold", "x", at(0)), ("held", 1, "hold", "y", at(1)), ("held", 2, "release", "x", at(2)), ("idle", 0, "use", None, at(0)), ("busy", 0, "hold", "x", at(0)), ("busy", 1, "start", "r", at(1)), ("busy", 2, "release", "x", at(2)), ("stop", 0, "start", "r", at(0)), ("stop", 1, "stop", None, at(4)), ("stop", 2, "stop", None, at(5))],
        [("busy", 3, "done", "r", at(3000)), ("odd", 0, "release", "z", at(3000)), ("back", 0, "hold", "x", at(2990)), ("back", 1, "release", "x", at(2991)), ("back", 2, "hold", "x", at(2995)), ("back", 3, "use", None, at(3000))],
        [("late", 0, "use", None, at(9000)), ("back", 4, "release", "x", at(9000))],
        [("idle", 1, "use", None, at(9001)), ("late", 1, "use", None, at(9001))],
        [("far", 0, "hold", "x", at(90_000))],
        [("far", 1, "use", None, at(90_001))],
    ]
    for k, rows in enumerate(batches):
        rocks.createDataFrame(rows, USES).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = rocks.readStream.schema(USES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = expiring.ended_sessions(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(200)
    rows = sorted((r.session_id, (r.ended - start).total_seconds(), r.why, r.busy) for r in rocks.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [("back", 9010, "holder left", False), ("busy", 3000, "holder left", False), ("idle", 900, "idle", False), ("idle", 9901, "idle", False), ("late", 9901, "idle", False), ("stop", 4, "stopped", True)]
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert left[-1] < max(left)  # far and held stay, nothing else


class _Store:
    """A session's state held here, which counts how often it is asked or told."""

    def __init__(self):
        self.calls, self.value, self.maps, self.timers = 0, None, {}, []

    def getValueState(self, name, schema):
        return _Value(self)

    def getMapState(self, name, key, value):
        return _Map(self, self.maps.setdefault(name, {}))

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class _Value:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return self.store.value

    def exists(self):
        return self.get() is not None

    def update(self, value):
        self.store.calls += 1
        self.store.value = value


class _Map:
    def __init__(self, store, held):
        self.store, self.held = store, held

    def _counted(self, what):
        self.store.calls += 1
        return what

    def iterator(self):
        return self._counted(iter(list(self.held.items())))

    def containsKey(self, key):
        return self._counted(key in self.held)

    def updateValue(self, key, value):
        self._counted(self.held.__setitem__(key, value))

    def removeKey(self, key):
        self._counted(self.held.pop(key))

    def clear(self):
        self._counted(self.held.clear())


def _run(processor, batches):
    """The rows of ``processor`` over batches of one session, and the calls to its store."""
    store = _Store()
    processor.init(store)
    out = []
    for b in batches:
        out += [tuple(r) for frame in processor.handleInputRows(("s",), iter(b), None) for r in frame.itertuples(index=False)]
    return out, store


def _frame(rows, columns):
    return pd.DataFrame(rows, columns=columns).assign(ts=lambda d: pd.to_datetime(d["ts"], unit="s"))


def test_numbers_ask_the_store_once_a_batch():
    columns = ["session_id", "document", "kind", "backend", "seq", "pos", "ts"]
    rows = [("s", "d", "ab"[k % 2], k * 7 % 5, k, 0, k * 60 + k // 9 * 3600) for k in range(360)]
    known, counters, epoch, told = set(), {}, -1, []
    for k, r in enumerate(rows):
        if k == 0 or r[6] - rows[k - 1][6] > 900:
            known, counters, epoch = set(), {}, epoch + 1
        if r[2:4] not in known:
            known.add(r[2:4])
            counters[r[2]] = counters.get(r[2], 0) + 1
            told.append(("s", "d", epoch, *r[2:4], counters[r[2]]))
    for cuts in ([0, 360], [0, 100, 104, 250, 360]):
        batches = [[_frame(rows[a:b][::-1], columns)] for a, b in zip(cuts, cuts[1:], strict=False)]
        out, store = _run(expiring._Numbers(900_000), batches)
        assert out == told
        assert store.calls <= 40 * len(batches)
        assert len(store.timers) == 1


def test_toasts_ask_the_store_once_a_batch():
    columns = ["session_id", "seq", "what", "node", "inside", "text", "ts"]
    rng = random.Random(5)
    rows = []
    for k in range(400):
        node = rng.randrange(8)
        rows.append(("s", k, rng.choice(["add"] * 8 + ["remove"] * 5 + ["drain"]), node, [node - 4] if node >= 4 else [], rng.choice(["", "t0", "t1", "t2"]), k))
    held, told, expected = {}, set(), []
    for _, seq, what, node, inside, text, _ in rows:
        if what == "drain":
            held, told = {}, set()
        elif what == "add":
            if not held.keys() & {node, *inside}:
                held[node] = (inside, text)
        else:
            for k in sorted(k for k, v in held.items() if node in (k, *v[0])):
                said = held.pop(k)[1]
                if said and said not in told:
                    told.add(said)
                    expected.append((seq, said))
    for cuts in ([0, 400], [0, 90, 93, 250, 400]):
        batches = [[_frame(rows[a:b][::-1], columns)] for a, b in zip(cuts, cuts[1:], strict=False)]
        out, store = _run(expiring._Toasts(900_000), batches)
        assert [r[1:3] for r in out] == expected
        assert [r[3] for r in out] == [pd.Timestamp(r[1], unit="s") for r in out]
        assert store.calls <= 40 * len(batches)
