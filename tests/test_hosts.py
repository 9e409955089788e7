"""Private hosts in every spelling, IPv6 included, judged where requests are."""

from __future__ import annotations

from folioscan.operators import policy

PRIVATE = ["[::1]", "[::]", "[fe80::1]", "[fe80::1%25eth0]", "[fc00::2]", "[fd12:3456::1]", "[ff02::fb]", "[::ffff:10.0.0.1]", "[::ffff:7f00:1]", "[64:ff9b::192.168.1.1]", "[64:ff9b::a00:1]", "127.1", "0x7f.1", "017700000001", "2130706433", "10.9.8.7", "172.31.0.1", "192.168.0.9", "169.254.1.1", "100.64.0.1", "0.0.0.0", "localhost", "a.localhost", "LOCALHOST."]
PUBLIC = ["[2001:db8::1]", "[2606:4700::6810:84e5]", "[::ffff:8.8.8.8]", "[64:ff9b::808:808]", "[ff05::2]", "8.8.8.8", "172.32.0.1", "100.128.0.1", "example.org", "localhost.example.org", "1.2.3.4.5", "[::g]"]


def test_private_hosts(spark):
    rows = [(h, True) for h in PRIVATE] + [(h, False) for h in PUBLIC]
    requests = spark.createDataFrame([(k, f"http://user:pw@{h}:8080/p?q#f", "Fetch", private) for k, (h, private) in enumerate(rows)], "k int, url string, kind string, private_host boolean")
    got = policy.judge_requests(requests).collect()
    wrong = [(r.url, r.reason) for r in got if (r.reason == "private address") != r.private_host]
    assert not wrong and len(got) == len(rows)
    assert all(r.allowed for r in policy.judge_requests(requests, allow_private=True).collect())
