from __future__ import annotations

import random

import pytest

from folioscan.llm import jaccard_join as J


def brute(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[x] = y
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {k: (least[find(k)], links[k]) for k in range(len(rows))}


def corpus(seed: int, bases: int, copies: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(bases):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, copies)):
            other = list(words)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts.append(" ".join(other))
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("seed,bases,copies", [(1, 60, 4), (2, 3, 120)])
def test_equals_brute_force(spark, monkeypatch, seed, bases, copies):
    monkeypatch.setattr(J, "BLOCK_ROWS", 40)  # the large group goes through pairs of blocks
    rows = corpus(seed, bases, copies)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=8).collect()}
    want = brute(rows)
    assert got == {i: want[k] for k, (i, _) in enumerate(rows)}


def test_edge_cases(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, " \n"), (6, "a b c d"), (None, "a b c"), (7, "x " * 30_000), (8, "x " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as node", "2 as path")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(docs).collect()}
    assert got[1] == got[2] == (1, 2) and got[3] == (3, 0) and got[4] == (4, 0) and got[5] == (5, 0) and got[6] == (6, 0)
    assert got[7] == got[8] == (7, 1) and got[None][1] == 2
    assert J.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_keeps_columns_and_nulls(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "z y x w v u"), (3, "z y x w v u"), (None, "a b c d e f g"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as class_id")
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (False, 3), (False, 9)]


def test_runs_reach_the_target():
    for target in (0.9, 0.999, 0.99999):
        runs, least = J.runs_needed(0.8, target)
        assert J.miss_chance(0.8, runs, least) <= 1 - target < J.miss_chance(0.8, runs - 1, least)
    assert J.runs_needed(0.8, 0.9)[0] < J.runs_needed(0.8, 0.99999)[0]


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity lies just above the threshold, against exact links."""
    rng = random.Random(11)
    rows, pairs = [], set()
    for i in range(1500):
        words = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        rows.append((2 * i, " ".join(words)))
        cut = 6 if i % 2 else 5  # 50 of 62, or 51 of 61 shingles
        rows.append((2 * i + 1, " ".join(words[:-cut] + [f"x{rng.randrange(10**9)}" for _ in range(cut)])))
        pairs.add((2 * i, 2 * i + 1))
    rows += [(9000, "z" * 3_000_000 + " a b c d e f"), (9001, "z" * 3_000_000 + " a b c d e f"), (9002, "z" * 2_999_999 + "y a b c d e f")]
    got = {r.doc_id: r.n_links for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == 1 for a, _ in pairs) >= 0.998 * len(pairs)
    assert (got[9000], got[9001], got[9002]) == (1, 1, 0)
