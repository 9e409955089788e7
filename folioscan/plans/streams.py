"""Registered streaming queries: each runs over the events table as a stream and must equal
its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import netlog
from folioscan.plans import sessions
from folioscan.streaming import events as ev
from folioscan.streaming.runs import run_available, run_closed, shared_path, table_stream


def _stream(spark, sf_dir):
    return table_stream(spark, f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session_id"), "event_type", "value", "props")


def stream_drained_events(spark, sf_dir):
    noted = _stream(spark, sf_dir).select("session_id", "ts", F.when(F.col("event_type") == "error", "console-error").otherwise(F.col("event_type")).alias("kind"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("text"))
    out = run_closed(noted, lambda e: ev.drain_windows(e, "6 hours"), "drained")
    return out.select("session_id", "window_start", "kind", netlog.event_text(F.col("text"), F.col("n")).alias("text"), "n")


def stream_bursts(spark, sf_dir):
    return run_closed(_stream(spark, sf_dir), lambda e: ev.bursts(e, "2 hours"), "bursts").select("session_id", "start", "n")


def stream_refs(spark, sf_dir):
    seen = _stream(spark, sf_dir).select("session_id", F.lit("d").alias("document"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("backend"), F.col("event_id").alias("seq"), F.lit(0).alias("pos"))
    return run_available(ev.stable_refs(seen), "refs").select("session_id", "kind", "backend", "number")


def stream_refusals(spark, sf_dir):
    docs = _stream(spark, sf_dir).where("event_type = 'error'").select("session_id", F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string")).alias("document"), "ts")
    return run_available(ev.once_per_document(docs, "365 days"), "refusals").select("session_id", "document")


def stream_toasts(spark, sf_dir):
    e = _stream(spark, sf_dir).select("session_id", F.get_json_object("props", "$.k").alias("node"), "ts", "event_type", F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("text"))
    added, removed = e.where("event_type = 'view'").select("session_id", "node", "ts", "text"), e.where("event_type = 'click'").select("session_id", "node", "ts")
    return run_available(ev.toasts(added, removed, "1 day", "40 days"), "toasts").select("session_id", "node", "text", "ts")


def stream_requests(spark, sf_dir):
    out = run_available(ev.fold_requests(netlog.protocol_events(sessions.protocol_of(_stream(spark, sf_dir))), "40 days"), "requests", "complete")
    return out.select("session_id", "request_id", "ts", "url", "kind", F.col("status").cast("long").alias("status"), "size")


def stream_pending(spark, sf_dir):
    """Requests without an answer in the month before the last event."""
    folded = run_available(ev.fold_requests(netlog.protocol_events(sessions.protocol_of(_stream(spark, sf_dir))), "40 days"), "requests", "complete")
    now = folded.agg(F.max("ts").cast("string")).first()[0] or "1970-01-01"
    return ev.pending(folded, now, "30 days").select("session_id", "request_id")


def stream_settled(spark, sf_dir):
    gap = F.when(F.col("event_type") == "view", "3 hours").when(F.col("event_type") == "click", "2 hours").otherwise("1 hour")
    return run_closed(_stream(spark, sf_dir), lambda e: ev.settled(e, "40 days", gap), "settled").select("session_id", "start", "end", "n")


def stream_visits(spark, sf_dir):
    out = run_closed(_stream(spark, sf_dir), ev.session_ends, "visits")
    return out.groupBy("session_id").agg(F.count("*").alias("visits"), F.max("end").alias("last_end"))


def stream_arriving(spark, sf_dir):
    kinds = F.when(F.col("event_type") == "error", "console-error").when(F.col("event_type") == "click", "dialog").otherwise(F.col("event_type"))
    seen = _stream(spark, sf_dir).select("event_id", "session_id", F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("document"), kinds.alias("kind"), F.col("props").alias("text"))
    now = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("session_id")).distinct().withColumn("document", F.lit("d1"))
    return run_available(ev.arriving(seen, now), "arriving").select("event_id", "kind", "text")


def stream_change_feed(spark, sf_dir):
    conv = table_stream(spark, f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    views = conv.select(F.col("conv_id").alias("session_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("capture_id"), F.col("turn").alias("seq"), F.lit("d").alias("document"), F.split("text", r"(?<=\.)\s+|\n").alias("lines"))
    return run_available(ev.change_feed(views), "feed").groupBy("capture_id", "op").agg(F.sum("n").cast("long").alias("n"))


def stream_kept_storage(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    seen = _stream(spark, sf_dir).select(F.concat(F.lit("n"), (F.col("session_id").cast("int") % 3).cast("string")).alias("name"), F.concat(F.lit("o"), k).alias("origin"), F.array(F.col("event_id")).alias("items"), F.col("ts").alias("seen"))
    out = shared_path(spark, "kept")
    table = lambda n: spark.read.parquet(f"{out}/v={n}") if n >= 0 else spark.createDataFrame([], seen.schema)
    last: list[int] = []

    def write(df, changed, n):
        df.write.mode("overwrite").parquet(f"{out}/v={n}")
        last.append(n)

    ev.keep_state(seen, lambda n: table(n - 1), write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table(max(last, default=-1)).select("name", "origin", F.array_join("items", ",").alias("items"), "seen")


QUERIES = {f.__name__: f for f in (stream_drained_events, stream_bursts, stream_refs, stream_refusals, stream_toasts, stream_requests, stream_pending, stream_settled, stream_visits, stream_arriving, stream_change_feed, stream_kept_storage)}

ORACLE_SQL = {
    "stream_requests": sessions.ORACLE_SQL["folded_requests"],
    "stream_visits": sessions.ORACLE_SQL["session_ends"],
    "stream_pending": f"with {sessions._PROTO} select session_id, request_id from f where status is null and ts > (select max(ts) from f) - interval '30 days'",
    "stream_settled": f"""with {sessions._E}, g as (select *, ts + case event_type when 'view' then interval '3 hours' when 'click' then interval '2 hours' else interval '1 hour' end as till from e),
m as (select *, max(till) over (partition by session_id order by ts rows between unbounded preceding and 1 preceding) as before from g),
s as (select *, sum((before is null or ts >= before)::int) over (partition by session_id order by ts rows unbounded preceding) as burst from m)
select session_id, min(ts) as start, max(till) as "end", count(*) as n from s group by session_id, burst""",
    "stream_arriving": """
with e as (select event_id, event_id % 3 <> 1 as old, case event_type when 'error' then 'console-error' when 'click' then 'dialog' else event_type end as kind, props from events)
select event_id, kind, case when old and kind = 'dialog' then 'on the previous page: ' || props else props end as text from e where not (old and kind = 'console-error')""",
    "stream_change_feed": f"with {sessions._MULTISET} select pair as capture_id, op, count(*) as n from d group by 1, 2 union all select capture_id, '=', count(*) from l join p on p.pair = l.capture_id where p.prev is null group by 1",
    "stream_kept_storage": """
with r as (select 'n' || (user_id % 3) as name, 'o' || json_extract_string(props, '$.k') as origin, arg_max(event_id, ts)::varchar as items, max(ts) as seen from events group by 1, 2)
select name, origin, items, seen from r qualify row_number() over (partition by name order by seen desc, origin) <= 50""",
    "stream_drained_events": sessions.ORACLE_SQL["drained_events"],
    "stream_bursts": sessions.ORACLE_SQL["activity_bursts"],
    "stream_refs": sessions.ORACLE_SQL["stable_refs"],
    "stream_refusals": "select distinct user_id::varchar as session_id, 'd' || (event_id % 4) as document from events where event_type = 'error'",
    "stream_toasts": """
with e as (select event_id, ts, user_id::varchar as session_id, event_type, json_extract_string(props, '$.k') as node from events)
select a.session_id, a.node, 't' || (a.event_id % 3) as text, a.ts from e a join e r on a.event_type = 'view' and r.event_type = 'click' and a.session_id = r.session_id and a.node = r.node and r.ts >= a.ts and r.ts <= a.ts + interval '1 day'""",
}
