"""Language-model scores, the quality classifier, shards and the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from folioscan.llm.bloom_lm import score_texts
from folioscan.llm.graph import connected_components
from folioscan.llm.kneser_ney import classify, fit, keep_good, score
from folioscan.llm.shard_sort import shard_documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_lm_scores(spark):
    rng = random.Random(4)
    words = ["the", "The", "Él", "rain", "in", "Spain", "stays"] + [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60), weights=[40] * 7 + [1] * 300)) if i % 17 else None) for i in range(400)]
    rows += [(7, "repeated row"), (7, "repeated row"), (None, "no id"), (900, ""), (901, "\x0b the \x0c"), (902, "long " * 40_000), (903, "q" * 3_000_000 + " the"), (904, "q" * 3_000_000), (905, "q" * 2_999_999 + "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as train", "2 as score", "3 as k")
    got = score_texts(docs).collect()
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None] for k, (_, t) in enumerate(rows)}
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(i), held[k], len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens[k]), 6)) for k, (i, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_texts(docs, segment_bytes=1).count() == len(rows)
    parts = {(r.doc_id, r.n_tokens): r.score for r in score_texts(docs, segment_bytes=1).collect()}
    assert all(abs(parts[r.doc_id, r.n_tokens] - r.score) < 1e-6 * abs(r.score) for r in got)
    assert score_texts(docs.limit(0)).count() == 0


def test_model_beats_the_base_on_held_out_text(spark):
    rng = random.Random(9)
    follow = {w: rng.choices(range(200), k=4) for w in range(200)}
    def walk():
        w, out = rng.randrange(200), []
        for _ in range(80):
            w = rng.choice(follow[w])
            out.append(f"t{w}")
        return " ".join(out)
    got = score_texts(spark.createDataFrame([(i, walk()) for i in range(300)], "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.3 * sum(r.n_tokens for r in got)


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney of order 3, straight from its formulas."""
    tri = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def discount(c):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = {}
        for k in (1, 2, 3):
            value = k - (k + 1) * y * n[k + 1] / n[k] if y is not None and n[k] else None
            d[k] = max(0.1, min(k - 0.1, value if value is not None else k - 0.5))
        return lambda x: d[min(x, 3)]

    levels = []
    for c in (tri, bi, uni):
        d = discount(c)
        by = defaultdict(list)
        for g, n in c.items():
            by[g[:-1] if isinstance(g, tuple) else ()].append(n)
        levels.append((c, d, {k: (sum(v), sum(map(d, v))) for k, v in by.items()}))

    def p(u, v, w):
        c, d, t = levels[2]
        total, left = t[()]
        out = ((c[w] - d(c[w])) / total if c[w] else 0) + left / total / (len(uni) + 1)
        for (c, d, t), g in ((levels[1], (v, w)), (levels[0], (u, v, w))):
            if g[:-1] in t:
                total, left = t[g[:-1]]
                out = ((c[g] - d(c[g])) / total if c[g] else 0) + left / total * out
        return out

    return p


def test_model_equals_the_formulas(spark):
    rng = random.Random(1)
    train = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 30))) for _ in range(40)]
    asked = [*train[:5], "a b zz c", "", "zz", "a b " + "z" * 3_000_000 + " c d"]
    model = fit(spark.createDataFrame([(t, "en") for t in train], "text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").selectExpr("*", "'en' as lang")
    got = {r.id: r for r in score(docs, model).collect()}
    p = kneser_ney(train)
    for i, t in enumerate(asked):
        w = ["<s>", "<s>", *t.split(), "</s>"]
        assert got[i].n_tokens == len(w) - 2
        assert got[i].log10_prob == pytest.approx(sum(math.log10(p(*g)) for g in zip(w, w[1:], w[2:], strict=False)), rel=1e-5)


def trusted_corpus():
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in ("ba", "co", "di") for b in ("na", "re", "ti", "so")]
    good = [(i, " ".join(rng.choices(vocab, k=rng.randint(20, 80))), "en" if i % 4 else "de") for i in range(400)]
    bad = [(1000 + i, " ".join("".join(rng.choices("QXZ!", k=6)) for _ in range(60)), "en" if i % 4 else "de") for i in range(40)]
    return good, bad


def test_classifier_keeps_good_and_rejects_junk(spark):
    good, bad = trusted_corpus()
    docs = spark.createDataFrame([*good, *bad, (5000, None, None), (5001, "", "xx"), (None, "no id", "en"), good[0]], "doc_id long, text string, lang string").selectExpr("*", "1 as keep", "2 as id")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good[:300]] + [(1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels, max_train_docs=64).collect()
    assert len(got) == len(good) + len(bad) + 4
    keep = {r.doc_id: r.keep for r in got}
    assert sum(keep[i] for i, _, _ in good) >= 0.99 * len(good) and not any(keep[i] for i, _, _ in bad)
    assert keep[5001] and keep[5000]
    left = keep_good(docs, labels, max_train_docs=64)
    assert left.columns == docs.columns and 1000 not in {r.doc_id for r in left.collect()}
    assert classify(docs, labels.limit(0)).where("not keep").count() == 0
    assert classify(docs.limit(0), labels).count() == 0


def test_shards_hold_near_equal_bytes_and_gapless_slots(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 400) if i % 3 else "hot group") for i in range(3000)]
    rows += [(None, "null id"), (5, None), (5, None), (1 << 62, "far"), (-(1 << 62), "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as shard", "'c' as h", "1 as i")
    got = shard_documents(docs, 40).collect()
    assert len(got) == len(rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 16
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * 416
    # the same cut by brute force: rows in key order, each to the shard its bytes reach
    keyed = docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as k", "coalesce(doc_id, -9223372036854775808) as i", "octet_length(coalesce(text, '')) + 16 as n").collect()
    keyed.sort(key=lambda r: (r.k, r.i))
    total, run, want = sum(r.n for r in keyed), 0, {}
    for r in keyed:
        want[r.k, r.i] = next(x for x in range(39, -1, -1) if run >= x * total / 40 or x == 0)
        run += r.n
    exact = {(r.doc_id): r.shard for r in shard_documents(docs, 40, tolerance=0).collect()}
    assert all(exact[r.doc_id] == want[r.k, r.i] for r in keyed if r.doc_id != 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "90")  # shards in parts
    try:
        fine = shard_documents(docs, 40).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    again = defaultdict(list)
    for r in fine:
        again[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in again.values())
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in fine if r.doc_id != 5) == sorted((str(r.doc_id), r.shard, r.slot) for r in got if r.doc_id != 5)
    loose = Counter()
    for r in shard_documents(docs, 40, tolerance=0.05).collect():
        loose[r.shard] += r.size
    assert max(loose.values()) <= 1.25 * sum(loose.values()) / 40
    assert shard_documents(docs.limit(0), 40).count() == 0
    assert {r.shard for r in shard_documents(docs.limit(1), 3).collect()} <= {0, 1, 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, j) for j in range(101, 160)] + [(7, 7), (200, 200), (None, 3), (3, 4), (4, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {200: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    good, bad = trusted_corpus()
    item = " ".join(f"q{i}" for i in range(25))
    words = good[3][1].split()
    more = [(2000, good[1][1], "en"), (2001, good[2][1] + " " + item, "en"), (2002, good[3][1] + " mail me.too@host.org", "de"), (2003, None, None)]
    rows = [(i, t, g, "src", len(t or "")) for i, t, g in [*good, *bad, *more]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in good[:300]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    assert not kept[0] & {i for i, _, _ in bad} and {2000, 2002, 2003} <= kept[0]
    assert 1 in kept[1] and 2000 not in kept[1]
    assert 2001 not in kept[2] and {1, 3} <= kept[2]
    masked = spark.read.parquet(f"{tmp_path}/pii").where("text like '%me.too@%'")
    assert masked.count() == 0 and len(words) > 0
    assert pipeline.run(spark, str(tmp_path)).count() == len(kept[-1])


def test_sample_is_dealt_by_language(spark):
    rows = [(i, "the cat sat on the mat and saw %d" % (i % 5), "en") for i in range(300)] + [(1000 + i, "un dos tres cuatro cinco seis %d" % (i % 2), "es") for i in range(8)] + [(2000, "ein zwei drei", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("lang <> 'de'").selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = classify(docs, labels, max_train_docs=2).collect()
    assert all(r.perplexity < 1000 and r.threshold < 1000 for r in got if r.lang == "es")
    assert all(r.threshold is None and r.keep for r in got if r.lang == "de")


def test_thresholds_and_verdicts_equal_brute_force(spark):
    good, bad = trusted_corpus()
    docs = spark.createDataFrame([*good, *bad, (None, bad[0][1], bad[0][2]), (0, bad[1][1], bad[1][2])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good], "doc_id long, quality int, toxic int")
    got = classify(docs, labels, max_train_docs=50, share=0.9, slack=0.3).collect()
    half = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").distinct().collect()}
    first = {i: lang for i, _, lang in sorted(good, key=lambda r: r[2] != "de")}
    turns: dict[str, int] = defaultdict(int)
    ranked = []
    for i in sorted((i for i in first if half[i] % 2 == 0), key=lambda i: (half[i], i)):
        turns[first[i]] += 1
        ranked.append((turns[first[i]], half[i], i))
    sample = {i for _, _, i in sorted(ranked)[:50]}
    lp = {lang: sorted(math.ceil(-r.log10_prob / r.n_tokens / 0.001) for r in got if r.lang == lang and r.doc_id in first and r.doc_id not in sample) for lang in ("en", "de")}
    cut = {lang: v[math.ceil(0.9 * len(v)) - 1] * 0.001 for lang, v in lp.items()}
    for r in got:
        assert math.log10(r.threshold) == pytest.approx(cut[r.lang], abs=1e-9)
        assert r.keep == (-r.log10_prob / r.n_tokens <= cut[r.lang] + 0.3 / math.sqrt(r.n_tokens))
    left = keep_good(docs, labels, max_train_docs=50, share=0.9, slack=0.3).collect()
    kept = Counter((r.doc_id, r.keep) for r in got)
    assert sum(n for (_, k), n in kept.items() if k) == len(left)
    assert not any(r.doc_id is None for r in left) and (0, good[0][1]) in {(r.doc_id, r.text) for r in left}
