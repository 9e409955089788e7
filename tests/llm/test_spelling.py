"""Spelling variants by brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from folioscan.llm import spelling
from folioscan.llm.spelling import damaged_runs, near_pairs, variant_forms, vocabulary

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, every):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_forms(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def corpus(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeÉéü", k=rng.randint(5, 8))) for _ in range(60)] + ["aabbccdd", "aabbcdd", "aabcdd"]
    def slip(w):
        for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
            k, c = rng.randrange(len(w)), rng.choice("abcdeÉéü")
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
        return w if rng.random() < 0.8 else w.upper()
    weights = [1 / (k + 1) for k in range(len(base))]
    return [(i, " ".join(slip(w) for w in rng.choices(base, weights, k=rng.randint(0, 220)))) for i in range(160)]


def test_forms_equal_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (None, "without id " * 9), (7, "aabbccdd, repeated row"), (7, "aabbccdd, repeated row"), (902, ("y" * 70_000 + " ") * 6 + ("y" * 69_999 + "z ") * 40), (903, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as id", "4 as run")
    words = brute_words(rows, 199)
    got = variant_forms(vocabulary(damaged_runs(docs)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    short = {w: n for w, n in words.items() if len(w) < 100}
    want = brute_forms(short)
    found = sorted((tuple(r) for r in got.collect()), key=lambda r: r[0])
    assert [r for r in found if len(r[0]) < 100] == want
    y, z = "y" * 70_000, "y" * 69_999 + "z"
    assert [r[1:] for r in found if r[0] == y] == [(z, z, words[y], 2 if "y" * 69_999 in words else 1, words[z])]
    assert any(r[1] for r in want) and max(r[4] for r in want) > 5


def test_damage_by_the_rule(spark):
    rows = corpus(4)
    words = brute_words(rows, 3)
    got = vocabulary(damaged_runs(spark.createDataFrame(rows, "doc_id long, text string"), every=3))
    assert {r.word: r.n for r in got.collect()} == words


def test_chains_reach_their_end(spark):
    n = {"abcdef" + "ghijklmnop"[:k]: 5**k for k in range(9)}
    got = variant_forms(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"abcdefghijklmn"} and sorted(map(tuple, got)) == brute_forms(n)


def test_rounds_and_parts_lose_no_pair(spark, monkeypatch):
    n = brute_words(corpus(6), 50)
    vocab = spark.createDataFrame(list(n.items()), "word string, n long")
    want = sorted((a, b) for a in n for b in n if one_edit(a, b))
    monkeypatch.setattr(spelling, "SEGMENT_KEYS", 16)
    assert sorted((r.word, r.near) for r in near_pairs(vocab, filter_bytes=256).collect()) == want


def test_filters_hold_every_word_and_few_others(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(20_000)]
    import numpy as np
    import pyarrow as pa

    keys = spelling.Spelled(pa.array(words)).keys()
    blocks = np.zeros(len(keys) // spelling.KEYS_A_BLOCK + 1, np.uint64)
    np.bitwise_or.at(blocks, spelling._block(keys, len(blocks)), spelling._mask(keys))
    parts = np.zeros(spelling.LONG + 1, np.int64)
    parts[10] = 1
    held = spelling.Filters(parts, {10: blocks.tobytes()})
    assert len(held.holds(keys, np.full(len(keys), 10))) == len(keys)
    other = spelling.Spelled(pa.array(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(100_000)])).keys()
    assert len(held.holds(other, np.full(len(other), 10))) < 0.02 * len(other)
    assert len(held.holds(keys, np.full(len(keys), 11))) == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variant_forms(vocabulary(damaged_runs(docs))).count() == 0
    one = variant_forms(spark.createDataFrame([("single", 7)], "word string, n long")).collect()
    assert [tuple(r) for r in one] == [("single", None, "single", 7, 0, None)]
