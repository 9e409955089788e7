"""Registered queries on text, addresses, policies and secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import colour, text, urls
from folioscan.operators import policy, redact
from folioscan.sources.stored import stored


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(spark, sf_dir):
    cleaned = _t(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("clean"))
    return cleaned.select("doc_id", F.md5("clean").alias("digest"), F.char_length("clean").cast("long").alias("chars"))


def block_lines(spark, sf_dir):
    kept = _t(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("kept"))
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_lines"), F.md5(F.array_join("kept", "\n")).alias("digest"))


def href_flatten(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.href(F.col("text"))).alias("href"), F.md5(text.flatten(F.col("text"))).alias("flat"))


def label_differs(spark, sf_dir):
    name, shown = text.first_line(F.col("text")), F.col("text")
    other = F.concat("source", F.substring_index("text", "\n", -1))
    return _t(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.label_differs(name, shown), F.lit(False)).alias("inside"), F.coalesce(text.label_differs(name, other), F.lit(False)).alias("elsewhere"))


def clip_quote(spark, sf_dir):
    flat = _t(spark, sf_dir, "documents").select("doc_id", text.flatten(F.col("text")).alias("flat"), text.first_line(F.col("text")).alias("first"))
    return flat.select("doc_id", text.quote(F.col("flat"), 60).alias("quoted"), text.clip_bytes(F.col("flat"), 61).alias("cut"), "first")


def token_estimate(spark, sf_dir):
    chars = F.aggregate(F.split("text", "\n"), F.lit(0), lambda a, x: a + F.char_length(x) + 1)
    return _t(spark, sf_dir, "documents").select("doc_id", text.token_estimate(chars).alias("tokens"))


def url_parts(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", urls.origin(u).alias("origin"), urls.web_origin(u).alias("web_origin"), urls.without_fragment(u).alias("document"), urls.with_scheme(F.regexp_replace(u, "^https?://", "")).alias("typed"))


_ODD = [("10.0.0.%d/", 256), ("172.%d.0.1/", 64), ("0x7f.%d/", 300), ("0%d.0.0.1/", 200), ("%d/", 2**32), ("127.0.0.%d:8080/", 256), ("foo%d.localhost/", 9), ("192.168.%d.1/", 300)]


def _odd_urls(pages: DataFrame) -> DataFrame:
    k = F.col("page_id") % len(_ODD)
    n = (F.col("page_id") * 2654435761) % 4294967296
    made = F.lit(None).cast("string")
    for i, (shape, most) in enumerate(_ODD):
        made = F.when(k == i, F.concat(F.lit("http://"), F.replace(F.lit(shape), F.lit("%d"), (n % most).cast("string")))).otherwise(made)
    return pages.select("page_id", made.alias("url"))


def private_spellings(spark, sf_dir):
    odd = _odd_urls(_t(spark, sf_dir, "pages"))
    host = urls.hostname(F.col("url"))
    return odd.select("page_id", host.alias("host"), urls.ipv4_value(host).alias("ipv4"), urls.private_host(host).alias("private"))


_ORIGINS = ["https://ththth.example.net", "https://m.ththth.example.net", "http://ththre.example.com"]


def request_verdicts(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    kinds = F.when(F.col("page_id") % 3 == 0, "Fetch").otherwise("Document")
    odd = _odd_urls(pages).withColumn("page_id", F.col("page_id") + 1_000_000)
    both = pages.select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("data:"), F.col("url"))).when(F.col("page_id") % 11 == 0, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url")).alias("url")).unionByName(odd).withColumn("kind", kinds)
    judged = policy.judge_requests(both, allowed=_ORIGINS)
    return judged.select("page_id", "allowed", F.coalesce("reason", F.lit("")).alias("reason"))


def cookie_admission(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    host = urls.hostname(F.col("url"))
    cookies = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("."), F.regexp_replace(host, r"^[^.]+\.", ""))).otherwise(host).alias("domain"), (F.col("page_id") % 100).cast("double").alias("expires"), (F.col("page_id") % 5 == 0).alias("session"))
    origins = pages.where("page_id % 50 = 0").select(urls.origin(F.col("url")).alias("origin")).distinct()
    return policy.admit_cookies(cookies, origins, 40.0).select("page_id", "expired", "reachable", "admitted")


def policy_within(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").withColumn("o", F.regexp_extract("url", r"^(https?://[^/?#]*)", 1))
    group = (F.col("page_id") % 97).alias("policy")
    p = pages.where("page_id % 4 = 0").groupBy(group).agg(F.lit(False).alias("allow_private"), F.array_sort(F.collect_set("o")).alias("origins"))
    q = pages.groupBy(group).agg(F.max((F.col("page_id") % 2 == 0)).alias("allow_private"), F.array_sort(F.collect_set(F.when(F.col("page_id") % 12 != 4, F.col("o")))).alias("origins"))
    return policy.within(p, q)


def challenge_wording(spark, sf_dir):
    conv = _t(spark, sf_dir, "conversations")
    phrase = F.when(F.col("conv_id") % 3 == 0, "Please verify you are a HUMAN; now").when(F.col("conv_id") % 3 == 1, "not-a-robot").otherwise("unusual trafficking")
    s = F.concat_ws(" ", F.col("text"), phrase)
    return conv.select("conv_id", "turn", (text.has_phrase(s) & (F.char_length(s) <= 600)).alias("challenge"))


def colours(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    i = F.col("event_id")
    r, g, b = i % 256, (i * 7) % 256, (i * 13) % 256
    named = F.when(i % 4 == 0, F.format_string("rgb(%d, %d, %d)", r, g, b)).when(i % 4 == 1, F.lower(F.format_string("#%02x%02x%02x", r, g, b))).when(i % 4 == 2, F.format_string("rgba(%d %d %d / 50%%)", r, g, b)).otherwise("teal")
    c = colour.parse_colour(named)
    white = F.struct(F.lit(255.0).alias("r"), F.lit(255.0).alias("g"), F.lit(255.0).alias("b"), F.lit(1.0).alias("a"))
    d = ev.select("event_id", c.alias("c"))
    flat = colour.over(F.col("c"), white)
    return d.select("event_id", F.round(F.col("c.r"), 3).alias("r"), F.round(F.col("c.g"), 3).alias("g"), F.round(F.col("c.b"), 3).alias("b"), F.round(F.col("c.a"), 3).alias("a"), F.round(colour.contrast(flat, white), 4).alias("contrast"), F.round(colour.distance(flat, white), 3).alias("distance"))


def _secrets(spark, sf_dir):
    """Every secret of every document, bound to the document's source; written, since finding
    them reads all texts and masking asks for them several times."""
    found = F.regexp_extract_all("text", F.lit(r"(?:password=|token = \")([0-9a-f]+)"), F.lit(1))
    held = _t(spark, sf_dir, "documents").select(F.explode(found).alias("value"), F.concat(F.lit("https://"), "source").alias("origin")).where("value <> ''").distinct()
    return stored(held, "secrets").withColumn("name", F.col("value"))


def secret_masking(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://"), "source").alias("origin"), "text")
    out = redact.mask_own(docs, _secrets(spark, sf_dir))
    return out.select("doc_id", F.md5("text").alias("digest"), F.col("text").contains(redact.MASK).alias("masked"))


def secret_scrub(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://src"), (F.col("doc_id") % 7).cast("string")).alias("origin"), "text")
    out = redact.scrub(docs, _secrets(spark, sf_dir))
    return out.select("doc_id", "refused", F.col("text").contains(redact.MASK).alias("masked"))


def archive_eligibility(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 17 == 0)).alias("uses_secret"), ((F.col("event_type") == "error") & (F.col("value") > 60)).alias("typed_password"))
    return redact.archivable(ev)


QUERIES = {f.__name__: f for f in (clean_text, block_lines, href_flatten, label_differs, clip_quote, token_estimate, url_parts, private_spellings, request_verdicts, cookie_admission, policy_within, challenge_wording, colours, secret_masking, secret_scrub, archive_eligibility)}

_CASES = "\n".join(f"when {i} then 'http://' || replace('{shape}', '%d', (n % {most})::varchar)" for i, (shape, most) in enumerate(_ODD))
_ODD_SQL = f"select page_id, case page_id % {len(_ODD)} {_CASES} end as url from (select page_id, ((page_id::hugeint * 2654435761) % 4294967296)::bigint as n from pages)"
_PRIVATE_SQL = """
odd as ({odd}),
h as (select page_id, url, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', '')) as host from odd),
p as (select page_id, url, host, string_split(host, '.') as parts from h),
num as (select page_id, url, host, case when regexp_full_match(host, '(0x[0-9a-f]+|0[0-7]*|[1-9][0-9]*)(\\.(0x[0-9a-f]+|0[0-7]*|[1-9][0-9]*)){{0,3}}') then
  list_transform(parts, lambda x: case when x like '0x%' then list_reduce(list_transform(string_split(substr(x, 3), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::bigint), lambda a, b: a * 16 + b)
    when regexp_full_match(x, '0[0-7]+') then list_reduce(list_transform(string_split(x, ''), lambda c: c::bigint), lambda a, b: a * 8 + b) else try_cast(x as bigint) end) end as v from p),
val as (select page_id, url, host, case when v is null then null when len(v) = 1 and v[1] < 4294967296 then v[1]
  when len(v) = 2 and v[1] <= 255 and v[2] < 16777216 then v[1] * 16777216 + v[2]
  when len(v) = 3 and v[1] <= 255 and v[2] <= 255 and v[3] < 65536 then v[1] * 16777216 + v[2] * 65536 + v[3]
  when len(v) = 4 and v[1] <= 255 and v[2] <= 255 and v[3] <= 255 and v[4] <= 255 then v[1] * 16777216 + v[2] * 65536 + v[3] * 256 + v[4] end as ipv4 from num),
priv as (select page_id, url, host, ipv4, host = 'localhost' or host like '%.localhost' or coalesce(ipv4 >> 24 in (127, 10, 0) or ipv4 >> 20 = 172 * 16 + 1 or ipv4 >> 16 in (192 * 256 + 168, 169 * 256 + 254) or ipv4 >> 8 = 224 * 65536 or ipv4 >> 22 = 100 * 4 + 1, false) as private from val)
"""
_PRIV = _PRIVATE_SQL.format(odd=_ODD_SQL)
_BLANKS = "[\\t\\n\\x0B\\f\\r ]+"
_SECRET_SQL = """
found as (select distinct 'https://' || source as origin, unnest(regexp_extract_all(text, '(?:password=|token = ")([0-9a-f]+)', 1)) as value from documents),
secrets as (select origin, list(value order by strlen(value) desc, value) as vals from found where value <> '' group by 1)"""

ORACLE_SQL = {
    "clean_text": f"select doc_id, md5(trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'))) as digest, length(trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'))) as chars from documents",
    "block_lines": """
with l as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\x0B\\f\\r ]+', ' ', 'g'))), chr(10)) as s from documents),
t as (select doc_id, regexp_replace(regexp_replace(regexp_replace(s, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+', ''), '\\n+$', '') as s from l)
select doc_id, case when s = '' then 0 else len(string_split(s, chr(10))) end::bigint as n_lines, md5(s) as digest from t""",
    "href_flatten": f"select conv_id, turn, md5(replace(trim(regexp_replace(text, '{_BLANKS}', ' ', 'g')), ' ', '%20')) as href, md5(regexp_replace(text, '[\\n\\r\\x0B\\f]', ' ', 'g')) as flat from conversations",
    "label_differs": """
with l as (select doc_id, lower(regexp_replace(string_split(text, chr(10))[1], '[^\\pL\\pM\\p{Nd}]', '', 'g')) as a, lower(regexp_replace(text, '[^\\pL\\pM\\p{Nd}]', '', 'g')) as b, lower(regexp_replace(source || string_split(text, chr(10))[-1], '[^\\pL\\pM\\p{Nd}]', '', 'g')) as c from documents)
select doc_id, a <> '' and b <> '' and not contains(a, b) and not contains(b, a) as inside, a <> '' and c <> '' and not contains(a, c) and not contains(c, a) as elsewhere from l""",
    "clip_quote": """
with f as (select doc_id, text, regexp_replace(text, '[\\n\\r\\x0B\\f]', ' ', 'g') as flat from documents),
q as (select *, case when length(flat) > 60 then substr(flat, 1, 59) || '…' else flat end as clipped,
 list_max(list_filter(range(0, 62), lambda n: strlen(substr(flat, 1, n)) <= 61)) as n from f)
select doc_id, '"' || replace(replace(clipped, '\\', '\\\\'), '"', '\\"') || '"' as quoted, case when strlen(flat) <= 61 then flat else substr(flat, 1, n) || '…' end as cut, string_split(text, chr(10))[1] as first from q""",
    "token_estimate": "select doc_id, ceil((length(text) + 1) / 4.0)::bigint as tokens from documents",
    "url_parts": "select page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, regexp_extract(url, '^(https?://[^/?#]*)', 1) as web_origin, string_split(url, '#')[1] as document, 'https://' || regexp_replace(url, '^https?://', '') as typed from pages",
    "private_spellings": f"with {_PRIV} select page_id, host, ipv4, private from priv",
    "request_verdicts": f"""with {_PRIV},
r as (select page_id, case when page_id % 7 = 0 then 'data:' || url when page_id % 11 = 0 then regexp_replace(url, '^https?', 'ftp') else url end as url, false as private from pages
 union all select page_id + 1000000, url, private from priv),
k as (select *, case when page_id % 3 = 0 then 'Fetch' else 'Document' end as kind, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) as origin from r),
j as (select page_id, case when url like 'data:%' and kind = 'Document' then 'document from opaque scheme' when url like 'data:%' then '' when url like 'ftp:%' then 'scheme not allowed'
 when private then 'private address' when kind = 'Document' and origin not in ({", ".join(f"'{o}'" for o in _ORIGINS)}) then 'outside the allowed origins' else '' end as reason from k)
select page_id, reason = '' as allowed, reason from j""",
    "cookie_admission": """
with h as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) as host, (page_id % 100)::double as expires, page_id % 5 = 0 as session from pages),
c as (select *, case when page_id % 2 = 0 then regexp_replace(host, '^[^.]+\\.', '') else host end as domain from h),
o as (select distinct host from h where page_id % 50 = 0),
r as (select distinct c.domain from c join o on o.host = c.domain or o.host like '%.' || c.domain)
select page_id, not session and expires > 0 and expires < 40 as expired, r.domain is not null as reachable, not (not session and expires > 0 and expires < 40) and r.domain is not null as admitted from c left join r using (domain)""",
    "policy_within": """
with g as (select page_id, page_id % 97 as policy, regexp_extract(url, '^(https?://[^/?#]*)', 1) as o from pages),
p as (select policy, list_distinct(list(o)) as origins from g where page_id % 4 = 0 group by 1),
q as (select policy, max((page_id % 2 = 0)::int) as private, coalesce(list_distinct(list(o) filter (page_id % 12 <> 4)), []) as origins from g group by 1)
select p.policy, len(q.origins) = 0 or len(list_filter(p.origins, lambda x: not list_contains(q.origins, x))) = 0 as within from p join q using (policy)""",
    "challenge_wording": """
select conv_id, turn, conv_id % 3 <> 2 and length(text || ' ' || case conv_id % 3 when 0 then 'Please verify you are a HUMAN; now' when 1 then 'not-a-robot' else 'unusual trafficking' end) <= 600 as challenge from conversations""",
    "colours": """
with c as (select event_id, event_id % 4 as k, event_id % 256 as r0, (event_id * 7) % 256 as g0, (event_id * 13) % 256 as b0 from events),
d as (select event_id, case when k = 3 then 0.0 else r0 end::double as r, case when k = 3 then 128.0 else g0 end::double as g, case when k = 3 then 128.0 else b0 end::double as b, case when k = 2 then 0.5 else 1.0 end::double as a from c),
f as (select *, r * a + 255 * (1 - a) as fr, g * a + 255 * (1 - a) as fg, b * a + 255 * (1 - a) as fb from d),
l as (select *, list_transform([fr, fg, fb], lambda x: case when x / 255 <= 0.03928 then x / 255 / 12.92 else pow((x / 255 + 0.055) / 1.055, 2.4) end) as n from f)
select event_id, round(r, 3) as r, round(g, 3) as g, round(b, 3) as b, round(a, 3) as a, round(1.05 / (0.2126 * n[1] + 0.7152 * n[2] + 0.0722 * n[3] + 0.05), 4) as contrast, round(sqrt(pow(fr - 255, 2) + pow(fg - 255, 2) + pow(fb - 255, 2)), 3) as distance from l""",
    "secret_masking": f"with {_SECRET_SQL}, m as (select doc_id, case when vals is null then text else list_reduce(list_prepend(text, vals), lambda t, v: replace(t, v, '••••')) end as t from documents left join secrets on origin = 'https://' || source) select doc_id, md5(t) as digest, contains(t, '••••') as masked from m",
    "secret_scrub": f"""with {_SECRET_SQL},
d as (select doc_id, 'https://src' || (doc_id % 7) as origin, text from documents),
m as (select doc_id, d.origin, case when vals is null then text else list_reduce(list_prepend(text, vals), lambda t, v: replace(t, v, '••••')) end as t from d left join secrets on secrets.origin = d.origin),
r as (select distinct doc_id from m join found s on s.origin <> m.origin and length(s.value) >= 8 and contains(m.t, s.value))
select m.doc_id, r.doc_id is not null as refused, r.doc_id is null and contains(t, '••••') as masked from m left join r using (doc_id)""",
    "archive_eligibility": "select user_id as session_id from events group by 1 having not bool_or((event_type = 'purchase' and event_id % 17 = 0) or (event_type = 'error' and value > 60))",
}
