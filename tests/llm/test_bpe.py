from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscan.llm import bpe
from folioscan.llm.kernels import buffers

SPEC = bpe.read_spec(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_str(SPEC)
PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", " ", "　", "'s", "1", "23", "!!", "<|endoftext|>", "中", "😀", "\x85", "x" * 30, " | ", "\r\n", "À"]


def ids(texts: list[str]) -> list[list[int]]:
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_library_on_mixed_text(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300))) for _ in range(400)] + ["", " ", "x" * 9000, "\n" * 500]
    data, off = buffers(pa.array(texts))
    assert [list(x) for x in bpe.Encoder(SPEC).encode(data, off)] == ids(texts)


def test_shared_chunks_are_encoded_once(monkeypatch):
    rng = random.Random(5)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "sigma"]) + str(rng.randint(0, 999)) for _ in range(3000))
    e = bpe.Encoder(SPEC)
    data, off = buffers(pa.array(["one two " + passage]))
    e.encode(data, off)
    met = len(e.cores)
    seen = []
    monkeypatch.setattr(e, "_encode_spans", lambda d, todo, firm, go=e._encode_spans: (seen.extend(todo), go(d, todo, firm))[1])
    data, off = buffers(pa.array(["three " + passage + " four"]))
    got = e.encode(data, off)
    assert met > 10 and sum(b - a for a, b in seen) < 0.2 * len(passage)
    assert [list(x) for x in got] == ids(["three " + passage + " four"])


def test_decode_bytes_and_broken_ids(spark):
    rows = [(1, "héllo <|endoftext|> wörld"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, SPEC), SPEC).collect()}
    assert out[1].text == rows[0][1] and out[2].ids == [] and out[3].text == ""
    odd = spark.createDataFrame([(1, [50257 + 5, -1, 198]), (2, None), (3, [447])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(odd, SPEC).collect()}
    assert got[1] == "\n" and got[2] is None and got[3] == LIBRARY.decode([447], skip_special_tokens=False)


def test_digests_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "same text", "x"), (1, "same text", "x"), (None, "other", "y"), (4, None, "z"), (5, "word " * 60_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip_digests(docs, SPEC).collect()
    assert len(out) == 5
    for r in out:
        text = next((t or "") for i, t, _ in rows if i == r.doc_id)
        i = ids([text])[0]
        assert r.n_tokens == len(i)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip_digests(docs.limit(0), SPEC).count() == 0


def test_cut_places_depend_on_nearby_bytes_alone():
    rng = np.random.default_rng(1)
    tail = rng.integers(97, 123, 20_000).astype(np.uint8)
    a = bpe.cut_places(tail)
    b = bpe.cut_places(np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), tail])) - 777
    assert set(a[a > 100]) == set(b[b > 100]) and len(a) > 10


def test_other_tokenizers_run_over_whole_texts():
    import json

    spec = json.loads(SPEC)
    assert bpe.cuts_at_blanks(SPEC)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"added_tokens": [*spec["added_tokens"], spec["added_tokens"][0] | {"id": 50257, "content": "the cat"}]}):
        other = json.dumps(spec | change)
        assert not bpe.cuts_at_blanks(other)
        texts = ["The cat sat on the cat. " * 200, "", "the cat"]
        data, off = buffers(pa.array(texts))
        assert [list(x) for x in bpe.Encoder(other).encode(data, off)] == [x.ids for x in Tokenizer.from_str(other).encode_batch(texts, add_special_tokens=False)]


def test_a_join_that_disagrees_widens_to_the_whole_text(monkeypatch):
    text = " ".join(f"word{i}" for i in range(4000))
    e = bpe.Encoder(SPEC)
    data, off = buffers(pa.array([text]))
    broken = lambda d, todo, firm, go=e._encode_spans: [x + (b - a < 12) for x, (a, b) in zip(go(d, todo, firm), todo, strict=True)]
    monkeypatch.setattr(e, "_encode_spans", broken)  # sides of windows come out wrong
    assert [list(x) for x in e.encode(data, off)] == ids([text])


def test_an_id_column_called_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (None, None)], "ids long, text string")
    assert bpe.encode(docs, SPEC, id_col="ids").columns == ["_ids", "ids"]
    assert {r._ids: r.n_tokens for r in bpe.round_trip_digests(docs, SPEC, id_col="ids").collect()} == {1: 2, None: 0}
