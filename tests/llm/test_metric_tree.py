from __future__ import annotations

import math
import random

from folioscan.llm.metric_tree import search, top_inner_products


def brute(rows, queries, k):
    ints = {}
    for n, (i, v) in enumerate(rows):
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints[n] = (i, [math.floor(1024 * x) for x in v])
    out = set()
    for q in {i for i, _ in ints.values()} & set(queries):
        own = next(v for i, v in ints.values() if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in ints.values() if i != q and len(v) == len(own))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def run(spark, rows, k=10, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'c' as pivot")
    out = top_inner_products(df, df.where("vec_id % 5 = 0"), k, **options)
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()}


def test_equals_brute_force_with_pages_and_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, 1.0, -1.0, 0.0, 0.125]) for i in range(80)]  # ties over several pages
    assert run(spark, rows, page_rows=16, pivots=8, run_bytes=4096) == brute(rows, [i for i, _ in rows if i % 5 == 0], 10)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [1.0, 2.0]), (10, None), (15, [nan, 1.0]), (20, [inf, 1.0]), (25, [None, 1.0]), (None, [1.0, 1.0]), (30, []), (35, [1.0, 2.0, 3.0]), (40, [-1.0, -2.0]), (41, [0.0004, 0.0])]
    assert run(spark, rows) == brute(rows, [i for i, _ in rows if i is not None and i % 5 == 0], 10)
    assert run(spark, [(1, [1.0])]) == set()


def test_bounds_avoid_most_scores(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 20) for _ in range(8)] for _ in range(40)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 40]]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = search(df, df.where("vec_id % 100 = 0"), 10, page_rows=32, pivots=64, run_bytes=16_384)
    blocks = {(r.computed, r.query_id) for r in found.collect()}
    total = sum(r[0] for r in found.groupBy("query_id").agg({"computed": "sum"}).selectExpr("`sum(computed)`").collect())
    assert blocks and total < 0.5 * 40 * 4000 * 10  # each part's count stands in each of its 10 rows
    assert run(spark, rows, page_rows=32, run_bytes=16_384) == brute(rows, [i for i, _ in rows if i % 5 == 0], 10)


def test_huge_components(spark):
    rows = [(0, [2.0**60, -(2.0**60)]), (5, [2.0**52, 2.0**52]), (1, [3.0, 2.0**55]), (2, [1.0, 1.0]), (10, [1e200, 1.0]), (3, [1e307, 0.0])]
    got = run(spark, rows)
    want = {(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute([x for x in rows if x[0] != 3], [0, 5, 10], 10)}
    assert {(q, i, s) for q, _, i, s in got} == {(q, i, s) for q, _, i, s in want}
