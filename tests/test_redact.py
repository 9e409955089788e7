"""Masking of many secrets against replacing each in turn."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from folioscan.operators import redact, spelled
from folioscan.operators.sieve import sieve


def brute(s, forms):
    for f in sorted(forms, key=lambda f: (-len(f.encode()), f.encode())):
        s = s.replace(f, redact.MASK) if s is not None else None
    return s


def test_masks_as_if_each_secret_were_tried(spark):
    rng = random.Random(5)
    long = "k" * 70
    values = ["a", "ab", "pass&word 1", "s3cr3t-key", "s3cr3t-key-2", "••••x", long + "1", long + "22", 'q"uo\\te', "ключ-секрет", ""] + [f"{rng.randrange(10**9):09d}" for _ in range(3000)]
    secrets = [(v, o, v) for v in values for o in ("o1", "o2") if (len(v) > 4 or o == "o1")]
    secrets += [("few", "o3", "s3cr3t-key"), ("few", "o3", "pass&word 1")]
    table = spark.createDataFrame(secrets, "name string, origin string, value string")
    forms: dict[str, set[str]] = {}
    for r in redact.secret_forms(table).collect():
        forms.setdefault(r.origin, set()).update(r.forms)
    words = values[1:30] + ["plain", "pass&amp;word 1", "pass%26word+1", "xs3cr3t-key-2x", long, long + "2", "•", "a•"]
    rows = [(k, rng.choice(["o1", "o2", "o3", None]), " ".join(rng.choices(words, k=rng.randrange(9))) if k % 17 else None, {"t": rng.choice(words), "u": None} if k % 3 else None) for k in range(400)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, origin string, text string, attrs map<string,string>")
    got = sorted(map(repr, ((r.doc_id, r.origin, r.text, r.attrs) for r in redact.mask_own(df, table, attrs_col="attrs").collect())))
    want = [(k, o, brute(s, forms.get(o, ())), None if a is None else {n: brute(v, forms.get(o, ())) for n, v in a.items()}) for k, o, s, a in rows]
    assert got == sorted(map(repr, want))
    assert any(redact.MASK in repr(r) for r in want)
    found = [(r.doc_id, r.origin) for r in redact.shown_elsewhere(df.dropDuplicates(["doc_id"]), table, "doc_id").join(df.select("doc_id", "origin").distinct(), "doc_id").collect()]
    guarded = {(r.origin, f) for r in redact.secret_forms(table).collect() if len(r.value) >= redact.GUARDED for f in r.forms}
    assert sorted(found) == sorted({(k, o) for k, o, s, _ in rows if s and o and any(x != o and f in s for x, f in guarded)})
    assert found
    assert redact.mask_own(df.limit(0), table).count() == 0
    assert redact.mask_own(df, table.limit(0)).count() == len(rows)


def test_sieve_keeps_every_key(spark):
    keys = spark.range(20_000).selectExpr("cast(id * 7 as string) as k")
    meets = sieve(keys, "k")
    assert keys.where(meets(F.col("k"))).count() == 20_000
    assert spark.range(20_000).selectExpr("concat('x', id) as k").where(meets(F.col("k"))).count() < 2_000
    assert keys.where(sieve(keys.limit(0), "k")(F.col("k"))).count() == 0


def test_texts_are_not_dealt_by_origin(spark):
    secrets = spark.range(redact.FEW + 1).select(F.lit("s").alias("name"), F.lit("https://a").alias("origin"), F.concat(F.lit("secret-word-"), "id").alias("value"))
    rows = spark.createDataFrame([("https://a", "of secret-word-7."), ("https://b", "of secret-word-7."), (None, "secret-word-7")], "origin string, text string")
    out = redact.mask_own(rows, secrets)
    assert sorted(r.text for r in out.collect()) == ["of secret-word-7.", f"of {redact.MASK}.", "secret-word-7"]
    assert not re.search(r"\[origin#\d+\], \[origin#\d+\], LeftSemi", out._jdf.queryExecution().executedPlan().toString())


def test_masks_the_same_by_joins(spark, monkeypatch):
    monkeypatch.setattr(redact, "MOST_PACKED", -1)
    test_masks_as_if_each_secret_were_tried(spark)


def test_spellings_of_any_length_are_found_at_their_places():
    rng = random.Random(7)
    forms = [b"a", "é".encode(), b"abc", b"abcdefgh", b"abcdefghi", b"abcdefgh-long", b"zz", bytes(8), "•x".encode()]
    table = spelled.Spellings([(o, f) for o in ("p", "q", "r") for f in forms if o != "r" or len(f) > 3], b"\xe2")
    texts = ["".join(rng.choices(["a", "é", "abc", "abcdefgh", "i", "-long", "z", "•", "x", " ", "abcdefg"], k=rng.randrange(12))) if k % 5 else None for k in range(600)]
    texts[7] = "abc" * 200_000
    rows = pa.array(texts)
    for part, at in ((rows, 0), (rows.slice(3, 400), 3), (rows.slice(599), 599), (rows.slice(0, 0), 0)):
        got = sorted(table.found(part))
        want = sorted((k, f) for k, t in enumerate(part.to_pylist()) if t for f in forms for m in re.finditer(b"(?=" + re.escape(f) + b")", t.encode()))
        assert got == want
    assert len(table.owners[b"abcdefgh"]) == 3 and len(table.owners[b"a"]) == 2 and table.anew[0] == ["•x".encode()]


def many_secrets(spark):
    rows = [(1, "https://a", "of secret-word-7."), (2, "https://b", "of secret-word-7."), (2, "https://b", "twin"), (None, "https://b", "secret-word-8"), (4, None, "secret-word-8"), (5, "https://b", None), (6, "https://c", "plain")]
    origin = F.concat(F.lit("https://"), F.when(F.col("id") < redact.FEW + 9, "a").otherwise("b"))
    secrets = spark.range(2 * redact.FEW).select(origin.alias("origin"), F.concat(F.lit("secret-word-"), "id").alias("value")).withColumn("name", F.col("value"))
    return spark.createDataFrame(rows, "doc_id long, origin string, text string"), secrets


def test_no_text_is_shuffled_to_mask_secrets(spark):
    df, secrets = many_secrets(spark)
    out = redact.mask_own(df, secrets)
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((k or 0, f"of {redact.MASK}." if k == 1 else s or "") for k, _, s in df.collect())
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["origin", "doc_id", "text"]


def test_no_text_is_shuffled_to_refuse_it(spark):
    df, secrets = many_secrets(spark)
    out = redact.scrub(df, secrets)
    got = sorted((r.doc_id or 0, r.text or "", r.refused) for r in out.collect())
    assert got == sorted([(1, f"of {redact.MASK}.", False), (2, redact.REFUSED, True), (2, redact.REFUSED, True), (0, "secret-word-8", False), (4, "secret-word-8", False), (5, "", False), (6, "plain", False)])
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["doc_id", "origin", "text", "refused"]
