from __future__ import annotations

import gzip
import hashlib
import random
import shutil
from pathlib import Path

from folioscan.llm import warc


def test_round_trip_and_revisits(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/ x\n", big), (2, "http://b", big), (7, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None), (6, "http://f", ""), (None, "http://g", "none"), (8, "u", "z" * 999), (9, "u", "z" * 999), (7, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as leader")
    path = str(tmp_path / "out")
    warc.write_warc(warc.plan_records(pages), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows) and not [r for r in got if r.error]
    for r in got:
        html = next((h or "") for i, _, h in rows if i == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 7) if r.page_id in (1, 2) else ("response", None))
        assert r.payload == (b"" if r.record_type == "revisit" else html)
    for f in Path(path).rglob("part-*"):
        data = f.read_bytes()
        if data:
            assert gzip.decompress(data).startswith(b"WARC/1.1")


def test_wide_record_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab" * (9 << 20)), (2, "u", "x")], "page_id long, url string, html string")
    path = str(tmp_path / "wide")
    warc.write_warc(warc.plan_records(pages), path)
    got = {r.page_id: r for r in warc.read_warc(spark, path, payloads=False).collect()}
    assert got[1].payload_bytes == 18 << 20 and got[1].error is None and got[2].error is None
    empty = str(tmp_path / "empty")
    warc.write_warc(warc.plan_records(pages.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_damage_is_reported_and_reading_goes_on():
    a, b = (warc._member(warc.page_record(i, "u", b"hello" * 50, hashlib.sha1(b"hello" * 50).hexdigest(), None)) for i in (1, 2))
    record = warc.page_record(3, "u", b"body", hashlib.sha1(b"other").hexdigest(), None)
    got = list(warc.read_records(a + warc._member(record) + b))
    assert [r["error"] for r in got] == [None, "payload digest", None]
    short = warc._member(record.replace(b"Content-Length: ", b"Content-Length: 9", 1))
    assert [bool(r["error"]) for r in warc.read_records(short + b)] == [True, False]
    assert [bool(r["error"]) for r in warc.read_records(a + b[: len(b) // 2])] == [False, True]
    assert [bool(r["error"]) for r in warc.read_records(a + b"garbage")] == [False, True]


def test_archives_are_read_by_splits(spark, tmp_path):
    """Members over several splits, and many in one; the same file under a name that Hadoop decompresses."""
    rng = random.Random(1)
    rows = [(i, f"http://a/{i}", "".join(rng.choices("abcdefghij \0é", k=rng.choice([0, 5, 300, 9000, 40_000])))) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "out")
    warc.write_warc(warc.plan_records(pages), path)
    want = sorted((i, hashlib.sha1(h.encode()).hexdigest(), None) for i, _, h in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = set()
    try:
        for size in ("4000b", "50k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.add(spark.read.option("lineSep", "\0").option("recursiveFileLookup", "true").text(path).rdd.getNumPartitions())
            got = warc.read_warc(spark, path).collect()
            assert sorted((r.page_id, r.payload_digest, r.error) for r in got) == want
            assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(seen) > 1
    named = tmp_path / "named"
    named.mkdir()
    for k, f in enumerate(Path(path).rglob("part-*")):
        if f.stat().st_size:
            shutil.copy(f, named / f"x{k}.warc.gz")
            (named / f"cut{k}.bin").write_bytes(f.read_bytes()[:-7])
    got = warc.read_warc(spark, str(named)).collect()
    assert sorted((r.page_id, r.payload_digest, r.error) for r in got if r.file.endswith(".gz")) == want
    cut = [r for r in got if r.file.endswith(".bin")]
    assert len(cut) == len(rows) and sum(bool(r.error) for r in cut) == 1
