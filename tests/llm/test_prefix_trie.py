"""The prefix trie by brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from folioscan.llm import prefix_trie as module
from folioscan.llm.prefix_trie import end_digests, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + mine[h:])
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, t in rebuilt.items():
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].add(c)
            if d:
                children[t[: d - 1]].add(t[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], digest(node)) for node, m in members.items()), key=str)


def got(spark, rows, **options):
    df = prefix_trie(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "2 as conv", "3 as part", "4 as a"), **options)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 260), 400, 463, 501, 777, 1200, 1201]:
        copy = rng.random() < 0.4
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 9])):
            text = f"common {turn}" if copy or rng.random() < 0.3 else rng.choice(["", "yes", "nö", f"own {c} {turn}"])
            rows.append((c, turn, rng.choice(["user", "user", "assistant"]), text))
    rows += [(3, None, None, None), (3, None, None, None), (3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (None, 1, "user", "no id"), (8, 1, "us", "er"), (9, 1, "use", "r"), (10, 5, "user", "ü😀" * 50_000)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = corpus()
    random.Random(seed).shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_long_conversations_and_many_copies_cross_segments(spark, monkeypatch):
    rows = [(c, t, "user", f"{t % 7}") for c in (0, 7) for t in range(400)] + [(c, t, "user", f"{t % 7} {'x' if t == 90 else ''}") for c in (200, 201) for t in range(120)]
    rows += [(c, t, "user", "same") for c in range(1000, 1300) for t in range(2)]
    want = brute(rows)
    monkeypatch.setattr(module, "SEGMENT", 16)
    assert got(spark, rows) == want


def test_digests_of_many_chunks(spark):
    rows = [(2, k % 3, -k % 3, c) for k in range(40) for c in range(k, 2000, 40)] + [(0, 0, 0, 9)]
    want = defaultdict(list)
    for *key, c in rows:
        want[tuple(key)].append(c)
    digests = end_digests(spark.createDataFrame(rows, "depth long, a long, b long, conv long"), most=7).collect()
    assert {tuple(r)[:3]: r.ends_sha256 for r in digests} == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_turnless_conversations_are_members_of_the_root(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(lone, 1, "user", "gone")]
    assert got(spark, rows) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_empty_table(spark):
    assert got(spark, []) == []
