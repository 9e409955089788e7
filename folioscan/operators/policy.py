"""Verdicts on requests, cookies and policies."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions import urls


@F.pandas_udf(T.BooleanType())
def _private_ipv6(hosts: pd.Series) -> pd.Series:
    nat64 = ipaddress.ip_network("64:ff9b::/96")
    shared = [ipaddress.ip_network(x) for x in ("0.0.0.0/8", "100.64.0.0/10")]
    own = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")]
    near = [ipaddress.ip_network(x) for x in ("224.0.0.0/24", "ff02::/16")]

    def one(host: str | None) -> bool:
        try:
            ip = ipaddress.ip_address((host or "").split("%")[0])
        except ValueError:
            return False
        if ip.version == 6 and ip in nat64:
            ip = ipaddress.ip_address(int(ip) & 0xFFFFFFFF)
        if ip.version == 6 and ip.ipv4_mapped:
            ip = ip.ipv4_mapped
        return ip.is_loopback or ip.is_link_local or ip.is_unspecified or any(ip.version == n.version and ip in n for n in [*shared, *own, *near])

    return hosts.map(one).astype("boolean")


def private_hosts(urls_df: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, private) for each distinct host; only hosts written with colons meet Python."""
    hosts = urls_df.select(urls.hostname(F.col(url_col)).alias("host")).where("host <> ''").distinct()
    six = hosts.where(F.col("host").contains(":")).withColumn("private", _private_ipv6("host"))
    return hosts.where(~F.col("host").contains(":")).withColumn("private", urls.private_host(F.col("host"))).unionByName(six)


def judge_requests(requests: DataFrame, *, url_col: str = "url", kind_col: str = "kind", allowed: list[str] | None = None, allow_private: bool = False) -> DataFrame:
    """``requests`` with (allowed, reason). Hosts repeat, so each distinct one is judged once
    and joined back; hot hosts are split by adaptive joins."""
    host = urls.hostname(F.col(url_col))
    judged = requests.withColumn("_host", host).join(private_hosts(requests, url_col).withColumnRenamed("host", "_host"), "_host", "left")
    private = F.lit(False) if allow_private else F.coalesce(F.col("private"), F.lit(False))
    origins = F.array(*[F.lit(o.lower()) for o in allowed]) if allowed else None
    reason = urls.request_reason(F.col(url_col), F.col(kind_col), private, origins)
    return judged.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).drop("_host", "private")


def admit_cookies(cookies: DataFrame, origins: DataFrame, now: float) -> DataFrame:
    """``cookies`` (domain, expires, session, ...) with (expired, reachable, admitted).

    A cookie reaches an allowed origin whose host is its domain or below it; hosts are
    exploded into their suffixes, so the test is a semi join on equality. Without origins
    every cookie is reachable. Session cookies never expire.
    """
    domain = F.lower(F.regexp_replace("domain", r"^\.", ""))
    labels = F.split(urls.hostname(F.col("origin")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    reach = origins.select(F.explode(suffixes).alias("_domain")).distinct().withColumn("_reached", F.lit(True))
    some = origins.limit(1).select(F.lit(True).alias("_some"))
    out = cookies.withColumn("_domain", domain).join(reach, "_domain", "left").join(F.broadcast(some.agg(F.count("*").alias("_some"))))
    expired = ~F.coalesce("session", F.lit(False)) & (F.coalesce("expires", F.lit(0.0)) > 0) & (F.col("expires") < now)
    reachable = F.coalesce("_reached", F.col("_some") == 0)
    return out.withColumns({"expired": expired, "reachable": reachable, "admitted": ~expired & reachable}).drop("_domain", "_reached", "_some")


def within(policies: DataFrame, other: DataFrame, key: str = "policy") -> DataFrame:
    """(policy, other, within): whether ``policy`` allows nothing that ``other`` forbids.
    Both have (policy, allow_private, origins); an empty list of origins allows all."""
    p, q = policies.select(*[F.col(c).alias(f"p_{c}") for c in (key, "allow_private", "origins")]), other.select(*[F.col(c).alias(f"q_{c}") for c in (key, "allow_private", "origins")])
    fits = (F.size("q_origins") == 0) | ((F.size("p_origins") > 0) & (F.size(F.array_except("p_origins", "q_origins")) == 0))
    both = p.join(q, F.col(f"p_{key}") == F.col(f"q_{key}"))
    return both.select(F.col(f"p_{key}").alias(key), (fits & (~F.col("p_allow_private") | F.col("q_allow_private"))).alias("within"))
