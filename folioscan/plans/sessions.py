"""Registered queries on sessions: view deltas, events, requests, programs, kept state."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import changes, netlog, programs, redact, state
from folioscan.streaming.runs import shared_path


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("user_id").cast("string").alias("session_id"), "event_type", "value", "props")


def _views(spark, sf_dir):
    """Successive assistant turns of a conversation are successive views of a session."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    return conv.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("capture_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("ts"), F.lit("d").alias("document"), "text")


def _lines(views, keyed: bool):
    at = F.posexplode(F.split("text", r"(?<=\.)\s+|\n"))
    each = views.select("capture_id", at.alias("pos", "body"))
    key = F.when(F.col("pos") % 2 == 0, F.col("pos") + 1).otherwise(0) if keyed else F.lit(0)
    return each.select("capture_id", "pos", key.cast("long").alias("key"), F.lit("").alias("ref"), F.lit("text").alias("label"), "body", F.array(F.substring("body", 1, 1)).alias("tags"), F.concat(F.lit("text "), "body").alias("text"))


def _delta(spark, sf_dir, keyed: bool):
    views = _views(spark, sf_dir)
    steps = changes.previous(views).where("prev_id is not null").select("capture_id", "prev_id")
    lines = _lines(views, keyed)
    old = lines.withColumnRenamed("capture_id", "prev_id").join(steps, "prev_id").drop("prev_id").withColumnRenamed("capture_id", "pair")
    return changes.diff(old, lines.join(steps.select("capture_id"), "capture_id").withColumnRenamed("capture_id", "pair"))


def view_diff(spark, sf_dir):
    return _delta(spark, sf_dir, True).groupBy("pair", "op").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).cast("long").alias("chars"))


def line_multiset_diff(spark, sf_dir):
    return _delta(spark, sf_dir, False).select("pair", "op", F.col("pos").cast("long").alias("pos"), "text")


def fitted_delta(spark, sf_dir):
    return changes.fit_delta(_delta(spark, sf_dir, False), 60).groupBy("pair").agg(F.count_if("kept").alias("kept"), F.max("left_out").alias("left_out"))


def change_feed(spark, sf_dir):
    views = _views(spark, sf_dir).withColumn("document", (F.col("ts") / 6).cast("int").cast("string"))
    return changes.change_feed(views, _lines(views, False)).groupBy("capture_id", "op").agg(F.count("*").alias("n"))


def session_epochs(spark, sf_dir):
    views = _events(spark, sf_dir).select("session_id", F.col("event_id").alias("capture_id"), F.col("event_type").alias("document"), "ts")
    return changes.previous(views).select("capture_id", "epoch", "new_document", "prev_id")


def stable_refs(spark, sf_dir):
    seen = _events(spark, sf_dir).select("session_id", F.lit(0).alias("epoch"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("backend"), F.col("event_id").alias("seq"), F.lit(0).alias("pos"))
    return changes.stable_refs(seen).select("session_id", "kind", "backend", F.col("number").cast("long").alias("number"))


def _noted(spark, sf_dir):
    return _events(spark, sf_dir).select("session_id", "ts", F.when(F.col("event_type") == "error", "console-error").otherwise(F.col("event_type")).alias("kind"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("text"))


def drained_events(spark, sf_dir):
    return netlog.drain_windows(_noted(spark, sf_dir), "6 hours").select("session_id", "window_start", "kind", netlog.event_text(F.col("text"), F.col("n")).alias("text"), "n")


def capped_events(spark, sf_dir):
    return netlog.cap_windows(netlog.drain_windows(_noted(spark, sf_dir), "7 days"), 10, 2)


def _protocol(spark, sf_dir):
    return protocol_of(_events(spark, sf_dir))


def protocol_of(e):
    """Events as protocol messages: views send, clicks answer, the others finish."""
    rid = F.concat(F.lit("r"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))
    kind = F.when(F.get_json_object("props", "$.k").cast("int") % 3 == 0, "Document").otherwise("Image")
    sent = F.to_json(F.struct(rid.alias("requestId"), kind.alias("type"), F.struct(F.concat(F.lit("https://h"), (F.col("event_id") % 5).cast("string"), F.lit("/#x")).alias("url"), F.lit("GET").alias("method")).alias("request")))
    answered = F.to_json(F.struct(rid.alias("requestId"), F.struct(F.when(F.col("value") > 20, 403).otherwise(200).alias("status"), F.lit("text/html").alias("mimeType")).alias("response")))
    done = F.to_json(F.struct(rid.alias("requestId"), F.col("event_id").alias("encodedDataLength")))
    method = F.when(F.col("event_type") == "view", "Network.requestWillBeSent").when(F.col("event_type") == "click", "Network.responseReceived").otherwise("Network.loadingFinished")
    params = F.when(F.col("event_type") == "view", sent).when(F.col("event_type") == "click", answered).otherwise(done)
    return e.select("session_id", "ts", method.alias("method"), params.alias("params"))


def folded_requests(spark, sf_dir):
    out = netlog.fold_requests(netlog.protocol_events(_protocol(spark, sf_dir)))
    return out.select("session_id", "request_id", "ts", "url", "kind", F.col("status").cast("long").alias("status"), "size")


def newest_requests(spark, sf_dir):
    e = _events(spark, sf_dir).select("session_id", "ts", F.col("event_id").alias("request_id"))
    return netlog.newest(e, 20).groupBy("session_id").agg(F.count("*").alias("n"), F.min("request_id").alias("oldest"))


def network_lines(spark, sf_dir):
    out = netlog.fold_requests(netlog.protocol_events(_protocol(spark, sf_dir)))
    return netlog.network_view(out).select("session_id", "request_id", "line")


def page_status(spark, sf_dir):
    e = _events(spark, sf_dir)
    doc = F.concat(F.lit("https://h"), (F.col("event_id") % 3).cast("string"), F.lit("/"))
    captures = e.where("event_type = 'click'").select("session_id", F.col("event_id").alias("capture_id"), doc.alias("document"), "ts")
    requests = e.where("event_type = 'view'").select("session_id", F.concat(doc, F.lit("#f")).alias("url"), F.lit("Document").alias("kind"), "ts", F.col("event_id").alias("status"))
    return netlog.status_as_of(captures, requests).select("capture_id", "status")


def failure_causes(spark, sf_dir):
    e = _events(spark, sf_dir)
    host = F.concat(F.lit("h"), F.get_json_object("props", "$.k"))
    failed = e.where("event_type = 'error'").select(F.col("event_id").alias("request_id"), host.alias("hostport"), "ts", (F.col("ts") - F.expr("interval 2 hours")).alias("since"))
    failures = e.where("event_type = 'view'").select(host.alias("hostport"), "ts", F.col("event_id").alias("cause"))
    return netlog.failure_cause(failed, failures).select("request_id", "cause")


def refused_documents(spark, sf_dir):
    e = _events(spark, sf_dir)
    docs = e.select("session_id", F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string")).alias("document"), "ts", F.when(F.col("event_type") == "error", 403).otherwise(200).alias("status"))
    return netlog.refusals(docs, "1 hour").select("session_id", "document", F.col("status").cast("long").alias("status"), "ts")


def activity_bursts(spark, sf_dir):
    return netlog.bursts(_events(spark, sf_dir), "2 hours").select("session_id", "start", "n")


def session_ends(spark, sf_dir):
    return netlog.bursts(_events(spark, sf_dir), "15 minutes").groupBy("session_id").agg(F.count("*").alias("visits"), F.max("end").alias("last_end"))


def shown_toasts(spark, sf_dir):
    e = _events(spark, sf_dir).select("session_id", F.get_json_object("props", "$.k").alias("node"), "ts", "event_type", F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("text"))
    return netlog.toasts(e.where("event_type = 'view'").select("session_id", "node", "ts", "text"), e.where("event_type = 'click'").select("session_id", "node", "ts"), "1 day")


def wait_results(spark, sf_dir):
    e = _events(spark, sf_dir)
    waits = e.where("event_type = 'click'").select(F.col("event_id").alias("wait_id"), "session_id", "ts", F.lit("7").alias("needle"), (F.col("event_id") % 2 == 0).alias("gone"))
    captures = e.where("event_type = 'view'").select("session_id", "ts", F.col("props").alias("text"))
    return netlog.wait_results(waits, captures, "3 hours").select("wait_id", "met_at")


def expectations(spark, sf_dir):
    e = _events(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("url-matches", "url-is", "text", "gone")]), (F.col("event_id") % 4 + 1).cast("int"))
    operand = F.when(kind == "url-matches", "h[12]$").when(kind == "url-is", "https://h0").otherwise("7")
    checks = e.where("event_type = 'click'").select(F.col("event_id").alias("check_id"), "session_id", "ts", kind.alias("kind"), operand.alias("operand"))
    captures = e.where("event_type = 'view'").select("session_id", "ts", F.concat(F.lit("https://h"), (F.col("event_id") % 3).cast("string")).alias("url"), F.col("props").alias("text"))
    return netlog.expectations(checks, captures).select("check_id", "met")


def kept_storage(spark, sf_dir):
    e = _events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    row = lambda t: e.where(F.col("event_type") == t).groupBy(F.concat(F.lit("n"), (F.col("session_id").cast("int") % 3).cast("string")).alias("name"), F.concat(F.lit("o"), k.cast("string")).alias("origin")).agg(F.array(F.min("event_id") % 2).alias("items"), F.max("ts").alias("seen"))
    return state.newest_sites(state.upsert_storage(row("view"), row("click")), 50).select("name", "origin", F.array_join("items", ",").alias("items"), "seen")


def _programs(spark, sf_dir):
    """A program for each first turn: lines made from its words."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0")
    word = F.regexp_replace("text", r"[^A-Za-z ]", "")
    return conv.select(F.col("conv_id").alias("program_id"), F.concat(F.lit("# start\ngoto https://example.com/\n\ntry  click \""), word, F.lit("\"\n"), F.when(F.col("conv_id") % 3 == 0, "fill t1 plain").when(F.col("conv_id") % 3 == 1, "dance").otherwise("fill t1 $secret:pw"), F.lit("\nwait seconds 2\nexpect text \"a\\\"b\"")).alias("program"))


def program_steps(spark, sf_dir):
    steps = programs.statements(_programs(spark, sf_dir))
    return steps.select("program_id", F.col("line").cast("long").alias("line"), "attempt", "verb", F.coalesce("error", F.lit("")).alias("error"))


def program_errors(spark, sf_dir):
    return programs.first_errors(programs.statements(_programs(spark, sf_dir))).select("program_id", F.col("line").cast("long").alias("line"), "message")


def canonical_programs(spark, sf_dir):
    return programs.canonical(programs.accepted(programs.statements(_programs(spark, sf_dir))))


def program_outcomes(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    reply = F.concat(F.lit("note: "), F.col("role"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\nfailed line "), (F.col("turn") + 1).cast("string"), F.lit(": click \"a: b\": no match\nskipped line 9: back: gone"))).otherwise("\nevent toast \"saved\""))
    r = conv.select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("program_id"), reply.alias("reply"))
    return programs.outcomes(r).select("program_id", F.col("failed_line").cast("long").alias("failed_line"), "cause", "skipped", "notes", "events")


def audit_round_trip(spark, sf_dir):
    """Turns as log records, written as JSON lines and read again."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = shared_path(spark, "audit")
    programs.write_audit(conv.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("time"), F.col("text").alias("program"), F.concat(F.col("role"), F.lit("\n\"x\\")).alias("reply")), path)
    return programs.read_audit(spark, path).select("time", F.md5("program").alias("digest"), "reply")


def challenges(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k = F.col("conv_id")
    pages = conv.select("conv_id", "turn", F.when(k % 2 == 0, "Checking  your browser... now").otherwise(F.col("text")).alias("text"), F.when(k % 3 == 0, 403).otherwise(200).alias("status"), (k % 5 == 0).alias("big_frame"), F.lit(None).cast("boolean").alias("slider"), (k % 9).cast("int").alias("tiles"))
    return netlog.challenge_pages(pages).select("conv_id", "turn", "challenge")


def rebound_refs(spark, sf_dir):
    """Refs of one view looked up in a later one: nodes of equal looks, told apart by place."""
    e = _events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    looks = [F.col("session_id").alias("page_id"), F.lit("link").alias("role"), F.col("event_type").alias("name"), F.lit("a").alias("tag"), (k % 5).cast("string").alias("stable")]
    lost = e.where("event_id % 2 = 0").select(*looks, F.concat(F.lit("l"), F.col("event_id").cast("string")).alias("ref"), (F.col("event_id") % 7).alias("position"))
    nodes = e.where("event_id % 2 = 1").select(*looks, F.col("event_id").alias("node"), (F.col("event_id") % 7).alias("position"))
    return changes.rebind(lost, nodes).select("page_id", "ref", "node", F.col("matches").cast("long").alias("matches"))


def masked_fields(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    rows = docs.select("doc_id", "source", F.lit("").alias("text"), F.create_map(F.lit("title"), F.concat(F.lit("key "), F.lit("s&cret"), F.col("source")), F.lit("id"), k.cast("string")).alias("attrs"), F.when(k % 2 == 0, "password").otherwise("text").alias("type"), F.when(k % 3 == 0, "").otherwise(F.col("source")).alias("value"))
    secrets = docs.select(F.col("source").alias("origin"), F.col("source").alias("name"), F.concat(F.lit("s&cret"), F.col("source")).alias("value")).distinct()
    out = redact.mask_own(rows, secrets, origin_col="source", attrs_col="attrs", type_col="type", value_col="value")
    return out.select("doc_id", F.col("attrs")["title"].alias("title"), "value")


QUERIES = {f.__name__: f for f in (view_diff, line_multiset_diff, fitted_delta, change_feed, session_epochs, stable_refs, drained_events, capped_events, folded_requests, newest_requests, network_lines, page_status, failure_causes, refused_documents, activity_bursts, session_ends, shown_toasts, wait_results, expectations, kept_storage, program_steps, program_errors, canonical_programs, program_outcomes, audit_round_trip, challenges, rebound_refs, masked_fields)}

_E = "e as (select event_id, ts, user_id::varchar as session_id, event_type, value, props, (json_extract_string(props, '$.k'))::bigint as k from events)"
_V = """v as (select conv_id || ':' || turn as capture_id, conv_id, turn, text from conversations where role = 'assistant'),
p as (select capture_id as pair, lag(capture_id) over (partition by conv_id order by turn, capture_id) as prev from v),
w as (select capture_id, string_split_regex(replace(text, '.' || chr(10), '.' || chr(1)), '\\n|\\x01') as chunks from v),
l0 as (select capture_id, list_transform(flatten(list_transform(chunks, lambda c: string_split(regexp_replace(c, '\\.[\\t\\x0B\\f\\r ]+', '.' || chr(2), 'g'), chr(2)))), lambda x: x) as parts from w),
l as (select capture_id, unnest(parts) as body, unnest(range(0, len(parts))) as pos from l0)"""
_MULTISET = _V + """,
c as (select coalesce(o.pair, n.pair) as pair, coalesce(o.body, n.body) as body, coalesce(o.c, 0) as o, coalesce(n.c, 0) as n from
 (select p.pair, body, count(*) as c from p join l on l.capture_id = p.prev group by all) o full join (select p.pair, body, count(*) as c from p join l on l.capture_id = p.pair where p.prev is not null group by all) n on o.pair = n.pair and o.body = n.body),
d as (select pair, '-' as op, pos, body from (select p.pair, l.pos, l.body, row_number() over (partition by p.pair, l.body order by l.pos) as k from p join l on l.capture_id = p.prev) r join c using (pair, body) where k <= o - n
 union all select pair, '+' as op, pos, body from (select p.pair, l.pos, l.body, row_number() over (partition by p.pair, l.body order by l.pos) as k from p join l on l.capture_id = p.pair where p.prev is not null) r join c using (pair, body) where k <= n - o)"""
_FEED = _MULTISET.replace("partition by conv_id order by turn, capture_id", "partition by conv_id, turn // 6 order by turn, capture_id")
_KEYED = _V + """,
a as (select p.pair, pos, body from p join l on l.capture_id = p.prev), b as (select p.pair, pos, body from p join l on l.capture_id = p.pair where p.prev is not null),
k as (select coalesce(a.pair, b.pair) as pair, a.body as ob, b.body as nb from (select * from a where pos % 2 = 0) a full join (select * from b where pos % 2 = 0) b on a.pair = b.pair and a.pos = b.pos),
dk as (select pair, case when nb is null then '-' when ob is null then '+' else '~' end as op, 'text ' || coalesce(nb, ob) as text, nb is null as gone, ob from k where ob is distinct from nb),
u as (select coalesce(o.pair, n.pair) as pair, coalesce(o.body, n.body) as body, coalesce(o.c, 0) - coalesce(n.c, 0) as d from (select pair, body, count(*) as c from a where pos % 2 = 1 group by all) o full join (select pair, body, count(*) as c from b where pos % 2 = 1 group by all) n on o.pair = n.pair and o.body = n.body),
x as (select pair, op, count(*) as n, sum(length(case when gone then trim(text) else text end)) as chars from dk group by all union all select pair, case when d > 0 then '-' else '+' end, sum(abs(d)), sum(abs(d) * length('text ' || body)) from u where d <> 0 group by all)"""
_PROTO = _E + """,
r as (select *, 'r' || (k % 10) as rid from e),
f as (select session_id, rid as request_id, min(ts) as ts, arg_max('https://h' || (event_id % 5) || '/#x', ts) filter (event_type = 'view') as url,
 arg_max(case when k % 3 = 0 then 'Document' else 'Image' end, ts) filter (event_type = 'view') as kind, arg_max(case when value > 20 then 403 else 200 end, ts) filter (event_type = 'click') as status,
 arg_max(event_id, ts) filter (event_type not in ('view', 'click')) as size, bool_or(event_type = 'click') as answered from r group by 1, 2)"""
_SPANS = _E + """,
g as (select *, case when ts - lag(ts) over (partition by session_id order by ts) < interval '{gap}' then 0 else 1 end as fresh from e),
s as (select *, sum(fresh) over (partition by session_id order by ts rows unbounded preceding) as visit from g)"""
_PROG = """g as (select conv_id as program_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') as word from conversations where turn = 0),
s as (select program_id, 2 as line, false as attempt, 'goto' as verb, '' as error, 'https://example.com/' as operands from g
 union all select program_id, 4, true, 'click', '', '"' || regexp_replace(word, ' +', ' ', 'g') || '"' from g
 union all select program_id, 5, false, case when program_id % 3 = 1 then 'dance' else 'fill' end, case program_id % 3 when 0 then 'bad operands of fill' when 1 then 'unknown statement dance' else '' end, 't1 $secret:pw' from g
 union all select program_id, 6, false, 'wait', '', 'seconds 2' from g union all select program_id, 7, false, 'expect', '', 'text "a\\"b"' from g)"""

ORACLE_SQL = {
    "audit_round_trip": "select conv_id || ':' || turn as time, md5(text) as digest, role || chr(10) || '\"x\\' as reply from conversations",
    "challenges": """
select conv_id, turn, coalesce((conv_id % 2 = 0 or regexp_matches(' ' || regexp_replace(lower(text), '[^\\pL\\p{Nd}]+', ' ', 'g') || ' ', ' (unusual traffic|verify you are human|verify you are a human|not a robot|are you a robot|checking your browser|complete the following challenge) '))
 and (conv_id % 2 = 0 or length(text) <= 600) and (conv_id % 3 = 0 or conv_id % 5 = 0 or conv_id % 9 >= 6), false) as challenge from conversations""",
    "rebound_refs": f"""with {_E}, b as (select *, k % 5 as s, event_id % 7 as pos from e),
p as (select l.event_id as ref, l.session_id, n.event_id as node, l.pos = n.pos as same from b l join b n on l.event_id % 2 = 0 and n.event_id % 2 = 1 and l.session_id = n.session_id and l.event_type = n.event_type and l.s = n.s),
g as (select ref, count(*) as matches, count(*) filter (same) as sames, min(node) as any_node, min(node) filter (same) as same_node from p group by 1)
select session_id as page_id, 'l' || event_id as ref, case when matches = 1 then any_node when sames = 1 then same_node end as node, coalesce(matches, 0) as matches from b left join g on g.ref = b.event_id where event_id % 2 = 0""",
    "masked_fields": "select doc_id, 'key ••••' as title, case when doc_id % 3 = 0 then '' when doc_id % 2 = 0 then '••••' else source end as value from documents",
    "line_multiset_diff": f"with {_MULTISET} select pair, op, pos, 'text ' || body as text from d",
    "view_diff": f"with {_KEYED} select pair, op, sum(n)::bigint as n, sum(chars)::bigint as chars from x group by 1, 2",
    "change_feed": f"with {_FEED} select pair as capture_id, op, count(*) as n from d group by 1, 2 union all select capture_id, '=', count(*) from l join p on p.pair = l.capture_id where p.prev is null group by 1",
    "fitted_delta": f"""with {_MULTISET}, r as (select pair, strlen('text ' || body) + 3 as b, row_number() over o as rank, sum(strlen('text ' || body) + 3) over o as used from d window o as (partition by pair order by case op when '-' then 0 else 1 end, pos, body))
select pair, count(*) filter (rank = 1 or used <= 240) as kept, count(*) filter (not (rank = 1 or used <= 240)) as left_out from r group by 1""",
    "session_epochs": f"""with {_E}, w as (select event_id, session_id, ts, event_type, lag(event_id) over o as prev_id, lag(event_type) over o as before from e window o as (partition by session_id order by ts, event_id)),
n as (select *, prev_id is null or event_type is distinct from before as new_document from w)
select event_id as capture_id, sum(new_document::int) over (partition by session_id order by ts, event_id)::bigint as epoch, new_document, prev_id from n""",
    "stable_refs": f"with {_E}, f as (select session_id, event_type as kind, k as backend, min(event_id) as first from e group by all) select session_id, kind, backend, row_number() over (partition by session_id, kind order by first, backend) as number from f",
    "drained_events": f"with {_E}, c as (select session_id, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as window_start, case when event_type = 'error' then 'console-error' else event_type end as kind, 'k' || k as text, count(*) as n from e group by all) select session_id, window_start, kind, case when n > 1 then text || ' (x' || n || ')' else text end as text, n from c",
    "capped_events": f"""with {_E}, c as (select session_id, time_bucket(interval '7 days', ts, timestamp '1970-01-01') as window_start, case when event_type = 'error' then 'console-error' else event_type end as kind, 'k' || k as text, count(*) as n, min(ts) as f from e group by all),
r as (select *, kind <> 'console-error' or row_number() over (partition by session_id, window_start, kind order by f, text) <= 2 as o from c),
a as (select *, sum(o::int) over (partition by session_id, window_start order by f, kind, text rows unbounded preceding) as nth from r)
select session_id, window_start, count(*) filter (o and nth <= 10) as shown, coalesce(sum(n) filter (o and nth > 10), 0)::bigint as hidden_events, coalesce(sum(n) filter (not o), 0)::bigint as hidden_console from a group by 1, 2""",
    "folded_requests": f"with {_PROTO} select session_id, request_id, ts, url, kind, status, size from f",
    "newest_requests": f"with {_E}, r as (select *, row_number() over (partition by session_id order by ts desc, event_id desc) as n from e) select session_id, count(*) as n, min(event_id) as oldest from r where n <= 20 group by 1",
    "network_lines": f"with {_PROTO} select session_id, request_id, concat_ws(' ', 'GET', url, status, case when answered then 'text/html' end, size) as line from f where kind = 'Document'",
    "page_status": f"""with {_E}, c as (select session_id, event_id, event_id % 3 as d, ts from e where event_type = 'click'), r as (select session_id, event_id, event_id % 3 as d, ts from e where event_type = 'view')
select c.event_id as capture_id, r.event_id as status from c asof left join r on c.session_id = r.session_id and c.d = r.d and c.ts >= r.ts""",
    "failure_causes": f"""with {_E}, c as (select event_id, k, ts from e where event_type = 'error'), r as (select event_id, k, ts from e where event_type = 'view')
select c.event_id as request_id, case when r.ts >= c.ts - interval '2 hours' then r.event_id end as cause from c asof left join r on c.k = r.k and c.ts >= r.ts""",
    "refused_documents": f"""with {_E}, w as (select session_id, 'd' || (event_id % 4) as document, ts, event_type, lead(ts) over (partition by session_id order by ts, 'd' || (event_id % 4)) as following from e)
select session_id, document, 403::bigint as status, min(ts) as ts from w where event_type = 'error' and (following is null or following > ts + interval '1 hour') group by 1, 2""",
    "activity_bursts": "with " + _SPANS.format(gap="2 hours") + " select session_id, min(ts) as start, count(*) as n from s group by session_id, visit",
    "session_ends": "with " + _SPANS.format(gap="15 minutes") + " select session_id, count(distinct visit) as visits, max(ts) + interval '15 minutes' as last_end from s group by session_id",
    "shown_toasts": f"""with {_E}, a as (select session_id, k, ts, 't' || (event_id % 3) as text from e where event_type = 'view'), r as (select session_id, k, ts from e where event_type = 'click'),
p as (select a.session_id, a.text, a.ts from a join r on a.session_id = r.session_id and a.k = r.k and r.ts >= a.ts and r.ts <= a.ts + interval '1 day')
select session_id, text, min(ts) as shown_at from p group by session_id, text, date_trunc('minute', ts)""",
    "wait_results": f"""with {_E}, w as (select event_id, session_id, ts, event_id % 2 = 0 as gone from e where event_type = 'click'), c as (select session_id, ts, props from e where event_type = 'view'),
m as (select event_id, min(c.ts) as met_at from w join c on w.session_id = c.session_id and c.ts >= w.ts and c.ts <= w.ts + interval '3 hours' and contains(props, '7') <> gone group by 1)
select event_id as wait_id, met_at from w left join m using (event_id)""",
    "expectations": f"""with {_E}, w as (select event_id, session_id, ts from e where event_type = 'click'), c as (select session_id, ts, event_id % 3 as h, props from e where event_type = 'view')
select w.event_id as check_id, coalesce(case w.event_id % 4 when 0 then h in (1, 2) when 1 then h = 0 when 2 then contains(props, '7') else not contains(props, '7') end, false) as met from w asof left join c on w.session_id = c.session_id and w.ts >= c.ts""",
    "kept_storage": f"""with {_E}, g as (select event_type, 'n' || (session_id::int % 3) as name, 'o' || k as origin, (min(event_id) % 2)::varchar as items, max(ts) as seen from e group by all),
o as (select * from g where event_type = 'view'), n as (select * from g where event_type = 'click'),
b as (select coalesce(o.name, n.name) as name, coalesce(o.origin, n.origin) as origin, coalesce(n.items, o.items) as items, case when n.items is null or n.items = o.items then o.seen else n.seen end as seen from o full join n on o.name = n.name and o.origin = n.origin)
select name, origin, items, seen from b qualify row_number() over (partition by name order by seen desc, origin) <= 50""",
    "program_steps": f"with {_PROG} select program_id, line::bigint as line, attempt, verb, error from s",
    "program_errors": f"with {_PROG} select program_id, line::bigint as line, error as message from s where error <> ''",
    "canonical_programs": f"with {_PROG} select program_id, string_agg(case when attempt then 'try ' else '' end || verb || ' ' || operands, chr(10) order by line) as program from s where program_id % 3 = 2 group by 1",
    "program_outcomes": "select conv_id || ':' || turn as program_id, case when turn % 2 = 0 then turn + 1 end as failed_line, case when turn % 2 = 0 then 'no match' end as cause, (turn % 2 = 0)::bigint as skipped, 1::bigint as notes, (turn % 2 = 1)::bigint as events from conversations",
}
