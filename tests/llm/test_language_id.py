"""Language identification: filters against exact sets, held-out accuracy, edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import language_id
from folioscan.llm.language_id import count_grams, fit, grams, identify, letters

SYLLABLES = {"aa": "ka lo mi ne pu ra si to vu".split(), "bb": "kal lor min nes puk ras sit tov vum".split(), "cc": "κα λο μι νε που ρα σι το".split()}


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, words(rng, lang, rng.randint(3, 60)), lang) for i in range(600) for lang in [rng.choice(["aa", "aa", "bb", "cc"])]]


def exact_grams(text):
    runs = ["" if w is None else f" {w} " for w in re.findall(r"[^\W\d_]+", text.lower())]
    return Counter(w[i : i + n] for w in runs for n in (3, 4) for i in range(len(w) - n + 1))


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_decides_as_exact_sets_do(spark, corpus):
    """The filter's corrected counts stay close to those of exact n-gram sets, and the
    decision equals theirs unless two languages are nearly tied."""
    counts, totals = defaultdict(Counter), Counter()
    for i, text, lang in corpus:
        if not held(i):
            found = exact_grams(text)
            totals[lang] += found.total()
            for g, n in found.items():
                counts[g][lang] += n
    sets = {g: {x for x in by if by[x] / totals[x] >= 0.5 * max(by[y] / totals[y] for y in by)} for g, by in counts.items()}
    for r in identify(spark.createDataFrame(corpus, "doc_id long, text string, lang string")).collect():
        found = exact_grams(corpus[r.doc_id][1])
        assert r.held_out == held(r.doc_id) and r.n_grams == found.total()
        true = {x: sum(n for g, n in found.items() if x in sets.get(g, ())) / found.total() for x in SYLLABLES}
        assert abs(r.score - true[r.lang_pred]) < 0.06
        assert true[r.lang_pred] >= max(true.values()) - 0.06


def test_held_out_accuracy(spark, corpus):
    got = [r for r in identify(spark.createDataFrame(corpus, "doc_id long, text string, lang string")).collect() if r.held_out]
    assert len(got) > 150
    assert sum(r.lang_pred == corpus[r.doc_id][2] for r in got) >= 0.98 * len(got)


def test_masks_return_every_language_of_a_gram(spark, corpus):
    rows = spark.createDataFrame(corpus, "doc_id long, text string, lang string").select(letters(F.col("text")).alias("text"), "lang")
    model = fit(rows, floor=0.0, share=0.0)
    assert model.languages == ["aa", "bb", "cc"]
    for k, lang in enumerate(model.languages):
        text = "".join(f" {w} " for _, t, of in corpus if of == lang for w in t.split())
        data = np.frombuffer(text.encode(), np.uint8)
        keys, _ = grams(data, np.array([0, len(data)]), len(data))
        assert (model.languages_of(keys)[:, 0] >> k & 1).all()
    other = np.arange(1, 200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seen = np.array([(model.languages_of(other)[:, 0] >> k & 1).mean() for k in range(3)])
    assert np.allclose(seen, model.false_rate, atol=0.004)


def test_small_filters_are_corrected(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    tight = identify(docs, filter_bytes=12 * 220)
    got = [r for r in tight.collect() if r.held_out]
    assert sum(r.lang_pred == corpus[r.doc_id][2] for r in got) >= 0.9 * len(got)


def test_many_languages(spark):
    rng = random.Random(8)
    rows = []
    for k in range(70):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)]
        rows += [(len(rows) + j, " ".join("".join(rng.choices(own, k=2)) for _ in range(30)), f"l{k:02}") for j in range(12)]
    got = [r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.97 * len(got)


def test_edge_cases(spark):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 3.4 -- \n", None), (4, "kalo mine", "aa"), (4, "kalo mine", "aa"), (None, "kalo pura", "aa"), (6, "λομι", None), (7, "Ǆ", "bb"), (8, "x" * 3_000_000, "bb"), (9, "kalo " * 500_000, "aa"), (10, "ß", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as id", "2 as score", "3 as held_out", "4 as n_grams")
    got = identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "n_grams"]
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
        assert 0 <= r.score <= 1
    assert [by[i][0].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[3][0].score == 0
    assert len(by[4]) == 2 and by[None][0].lang_pred == "aa" and not by[None][0].held_out
    assert by[6][0].lang_pred != "und" and by[8][0].n_grams == 2 * 3_000_000 - 1 + 0 and by[9][0].n_grams == 500_000 * 7
    none = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(rows)
    assert identify(docs.limit(0)).count() == 0


def test_slices_of_long_rows_lose_no_gram(monkeypatch):
    texts = [" kalo λομι mine ", "  ", " " + "που" * 90 + " ", " a ", " " + "nes vum " * 40]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])

    def found():
        return sorted((int(k), int(row + r)) for raw, at, row, most in language_id._pieces(data, off) for k, r in zip(*grams(raw, at, most), strict=True))

    want = found()
    assert len(want) == sum(exact_grams(t).total() for t in texts)
    monkeypatch.setattr(language_id, "SLICE", 64)
    assert found() == want


def test_tasks_add_up_what_they_hold(spark, corpus):
    rows = spark.createDataFrame(corpus, "doc_id long, text string, lang string").select(letters(F.col("text")).alias("text"), F.ascii("lang").alias("lang"))
    got = count_grams(rows).groupBy("lang").agg(F.sum("n")).collect()
    assert dict(map(tuple, got)) == {k: sum(exact_grams(t).total() for _, t, lang in corpus if ord(lang[0]) == k) for k in (97, 98, 99)}
