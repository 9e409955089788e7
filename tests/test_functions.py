from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscan import catalog
from folioscan.functions import colour, text, urls


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


CLEAN = [
    ("  a \n b\t c ", "a b c"),
    ("a​b", "ab"),
    ("a ​ b", "a b"),
    ("x‮y", "xy"),
    ("ㅤhiㅤ", "hi"),
    ("icon  save", "icon save"),
    ("क‍ष", "क‍ष"),
    ("a‍b", "ab"),
    ("👨‍👩", "👨‍👩"),
    ("️", ""),
    ("\x00\x07", ""),
    ("a b　c", "a b c"),
    (None, None),
]


def test_clean_and_idempotence(spark):
    got = apply(spark, text.clean, [v for v, _ in CLEAN])
    assert got == [w for _, w in CLEAN]
    assert apply(spark, text.clean, got) == got


def test_collapse_href_flatten_lines(spark):
    assert apply(spark, text.collapse, [" a  b ", "\n", "", "a"]) == [" a b ", " ", "", "a"]
    assert apply(spark, text.href, ["/a b\n"]) == ["/a%20b"]
    assert apply(spark, text.flatten, ["a\tb\nc  d​"]) == ["a\tb c  d"]
    assert apply(spark, text.lines, ["\n\n a  b \r\n\n\n\nc\n \n", "  "]) == [["a b", "", "c"], []]
    assert apply(spark, lambda c: text.lines(c, spaces=True), ["  a  b \n\tc"]) == [["  a  b", "\tc"]]


def test_labels_clips_tokens(spark):
    both = spark.createDataFrame([("Sign in", "sign-in now", False), ("Buy", "Delete", True), ("", "x", False)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in both.select(text.label_differs(F.col("a"), F.col("b")), "want").collect())
    assert apply(spark, lambda c: text.clip(c, 4), ["abcd", "abcde"]) == ["abcd", "abc…"]
    assert apply(spark, lambda c: text.clip_bytes(c, 4), ["aéb", "aéé", "éééé"]) == ["aéb", "aé…", "éé…"]
    assert apply(spark, lambda c: text.quote(c, 9), ['a"b\\']) == ['"a\\"b\\\\"']
    assert apply(spark, lambda c: text.token_estimate(F.char_length(c)), ["", "a", "abcde"]) == [0, 1, 2]
    assert apply(spark, text.has_phrase, ["Are you a ROBOT?", "not a robotics club", "un usual traffic"]) == [True, False, False]


def test_spellings(spark):
    got = apply(spark, text.spellings, ['a b"<&'])[0]
    assert {'a b"<&', "a b&#34;&lt;&amp;", "a+b%22%3C%26", "a%20b%22%3C&", 'a b\\"<&', 'a%20b"<&'} == set(got)
    assert [len(x.encode()) for x in got] == sorted((len(x.encode()) for x in got), reverse=True)


PRIVATE = ["127.0.0.1", "10.1.2.3", "172.31.0.1", "192.168.0.1", "169.254.1.1", "0.0.0.0", "100.64.0.1", "224.0.0.1", "2130706433", "0x7f000001", "0177.0.0.1", "127.1", "localhost", "a.localhost.", "0x7f.1"]
PUBLIC = ["8.8.8.8", "172.32.0.1", "11.0.0.1", "100.128.0.1", "example.com", "256.1.1.1", "1.2.3.4.5", "127.0.0.1.example.com", "08.8.8.8", "4294967296", ""]


def test_private_hosts(spark):
    assert all(apply(spark, urls.private_host, PRIVATE)) and not any(apply(spark, urls.private_host, PUBLIC))


def test_origins(spark):
    assert apply(spark, urls.origin, ["https://u:p@a.b:8/x?y#z", "mailto:x", "nothing", "data:text/html,x"]) == ["https://a.b:8", "mailto:", "", "data:"]
    assert apply(spark, urls.with_scheme, ["a.b/c", "host:80/x", "http://x", "mailto:a"]) == ["https://a.b/c", "https://host:80/x", "http://x", "mailto:a"]


@pytest.mark.parametrize("s,want", [("#fff", (255, 255, 255, 1)), ("#ff000080", (255, 0, 0, 128 / 255)), ("rgb(1, 2, 3)", (1, 2, 3, 1)), ("rgba(100% 0% 0% / 50%)", (255, 0, 0, 0.5)), ("Teal", (0, 128, 128, 1)), ("url(x)", None), ("#12", None)])
def test_colours(spark, s, want):
    got = apply(spark, colour.parse_colour, [s])[0]
    assert (tuple(got) if got else None) == (pytest.approx(want) if want else None)


@pytest.mark.parametrize("name", ["block_lines", "clip_quote"])
def test_texts_are_worked_out_once(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\p{Cc}") == 1  # the costly look at every character


def test_plain_and_unusual_texts_have_equal_lines(spark):
    """A sign that is drawn but unusual takes a text the long way, which must not tell."""
    rng = random.Random(4)
    parts = ["a", "Bé", " ", "  ", "\t", "\n", "\n", "\r\n", "\r", "\f", "\v", "ÿ", "¡", "ɏ"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(400)] + ["", "\n", "\r\n \r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for f in (lambda c: text.lines(c), lambda c: text.lines(c, spaces=True), lambda c: F.array(text.flatten(c))):
        short, long = F.array_join(f(F.col("t")), "|"), F.array_join(f(F.concat("t", F.lit("\n漢"))), "|")
        for r in df.select("t", F.concat(short, F.lit("|漢")).alias("a"), long.alias("b")).collect():
            assert r.a.replace("|", "").replace(" ", "") == r.b.replace("|", "").replace(" ", ""), r.t
