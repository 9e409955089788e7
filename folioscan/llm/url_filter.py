"""URL filters whose decisions reach aliases: redirects and canonical links tie URLs together.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .workspace import fresh, materialize


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (host and subdomains, path prefix) as struct(rule, verdict).
    Among rules of one length an allow wins, then the lesser name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", [-ord(c) for c in r.name])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def resolve(base: Column, target: Column) -> Column:
    """An absolute URL for a link found on ``base``; null where nothing can be made of it."""
    t = F.trim(target)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder)
    out = (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t == "", None)
        .when(t.startswith("//"), F.concat(scheme, t))
        .when(t.startswith("/"), F.concat(origin, t))
        .when(t.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), t))
        .when(~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(folder, t))
    )
    return resource(out)


def resource(url: Column) -> Column:
    """A URL without its fragment: what a redirect or canonical link names."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) URL pairs from every ``link rel=canonical`` and ``meta http-equiv=refresh``
    of a page, quoted or not. Null HTML and null URLs have none, links that name nothing are
    left out, repeated pairs come once, and an empty table gives no rows."""
    html = F.col(html_col)
    canonical = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    refresh = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    low = F.lower(html)
    likely = pages.where(F.col(url_col).isNotNull() & (low.contains("canonical") | low.contains("refresh")))
    found = likely.select(F.col(url_col).alias("_url"), F.explode(F.concat(canonical, refresh)).alias("_to")).where("_to <> ''")
    to = F.replace(F.col("_to"), F.lit("&amp;"), F.lit("&"))
    return found.select(resource(F.col("_url")).alias("src"), resolve(F.col("_url"), to).alias("dst")).where("dst is not null and src <> ''").distinct()


def judge_urls(pages: DataFrame, rules: list[Rule], *, redirects: DataFrame | None = None, default: str = "allow", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A page's own rule decides. A page without one takes its aliases' decision: an allow of
    any alias comes before any block, and without either ``default`` holds. Aliases are
    the URLs (fragments dropped) of one connected component of canonical links, refreshes
    and ``redirects`` (src, dst); rules count for every URL of the component, pages or not.
    Null URLs and URLs without ``://`` have empty host and path; null HTML has no links;
    rows may repeat; columns named like the new ones are replaced; empty tables stay empty.
    """
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(resource(F.col("src")).alias("src"), resource(F.col("dst")).alias("dst")))
    edges = materialize(edges.where("src <> dst").distinct(), "aliases")
    judged = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    hit = fresh(judged, "hit")
    judged = judged.withColumn(hit, rule_of(F.col("host"), F.col("path"), rules)).withColumn("rule", F.col(f"{hit}.rule"))
    if edges.limit(1).count() == 0:
        return judged.withColumn("verdict", F.coalesce(F.col(f"{hit}.verdict"), F.lit(default))).drop(hit)
    parts = materialize(connected_components(edges), "components")
    said = parts.withColumn("v", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules).getField("verdict"))
    by_part = said.groupBy("component").agg(F.max(F.col("v") == "allow").alias("allows"), F.max(F.col("v") == "block").alias("blocks"))
    decided = by_part.select("component", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("alias_verdict")).where("alias_verdict is not null")
    at, alias = fresh(judged, "at"), fresh(judged, "alias_verdict")
    by_url = parts.join(decided, "component").select(F.col("node").alias(at), F.col("alias_verdict").alias(alias))
    out = judged.withColumn(at, resource(F.col(url_col))).join(by_url, at, "left")
    return out.withColumn("verdict", F.coalesce(F.col(f"{hit}.verdict"), F.col(alias), F.lit(default))).drop(hit, at, alias)
