"""Requests and events of sessions: folding, counting, caps, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_REQUESTS, MOST_EVENTS, MOST_CONSOLE = 500, 30, 3
SHOWN_KINDS = ("Document", "Fetch", "XHR")
REFUSALS = (403, 429, 503)


def protocol_events(log: DataFrame) -> DataFrame:
    """(session_id, ts, request_id, method, url, kind, status, mime, size) of a protocol log
    (session_id, ts, method, params as JSON); fields that are absent or broken are null."""
    p = F.try_parse_json("params")
    get = lambda path, kind: F.try_variant_get(p, f"$.{path}", kind)
    return log.select("session_id", "ts", "method", get("requestId", "string").alias("request_id"), F.coalesce(get("request.url", "string"), get("response.url", "string")).alias("url"), get("type", "string").alias("kind"), get("request.method", "string").alias("verb"), get("response.status", "int").alias("status"), get("response.mimeType", "string").alias("mime"), get("encodedDataLength", "long").alias("size"))


def fold_requests(events: DataFrame) -> DataFrame:
    """One row for each request: the last values seen; redirects reuse the id."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    return events.where("request_id is not null").groupBy("session_id", "request_id").agg(F.min("ts").alias("ts"), *[last(c) for c in ("url", "kind", "verb", "status", "mime", "size")])


def newest(requests: DataFrame, most: int = MOST_REQUESTS, session: str = "session_id", tie: str = "request_id") -> DataFrame:
    """The ``most`` newest requests of each session: the feature's own limit."""
    w = Window.partitionBy(session).orderBy(F.col("ts").desc(), F.col(tie).desc())
    return requests.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def network_view(requests: DataFrame, most: int = MOST_REQUESTS) -> DataFrame:
    """(session_id, request_id, line): documents, fetches and XHRs as shown lines."""
    url = F.when(F.char_length("url") > 200, F.concat(F.substring("url", 1, 199), F.lit("…"))).otherwise(F.col("url"))
    shown = newest(requests, most).where(F.col("kind").isin(*SHOWN_KINDS))
    return shown.select("session_id", "request_id", F.concat_ws(" ", "verb", url, F.col("status").cast("string"), "mime", F.col("size").cast("string")).alias("line"))


def drain_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(session_id, window_start, kind, text, n, first_ts): repeats counted in tumbling windows."""
    out = events.groupBy("session_id", F.window("ts", width).alias("w"), "kind", "text").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    return out.select("session_id", F.col("w.start").alias("window_start"), "kind", "text", "n", "first_ts")


def cap_windows(drained: DataFrame, most: int = MOST_EVENTS, console: int = MOST_CONSOLE, console_kind: str = "console-error") -> DataFrame:
    """(session_id, window_start, shown, hidden_events, hidden_console): what a window shows of
    its distinct events and how many repeats the caps leave out."""
    by_kind = Window.partitionBy("session_id", "window_start", "kind").orderBy("first_ts", "text")
    order = Window.partitionBy("session_id", "window_start").orderBy("first_ts", "kind", "text")
    is_log = F.col("kind") == console_kind
    ranked = drained.withColumn("_log", F.when(is_log, F.row_number().over(by_kind)).otherwise(0))
    ranked = ranked.withColumn("_open", F.col("_log") <= console).withColumn("_at", F.sum(F.col("_open").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    shown = F.col("_open") & (F.col("_at") <= most)
    return ranked.groupBy("session_id", "window_start").agg(F.count_if(shown).alias("shown"), F.coalesce(F.sum(F.when(F.col("_open") & ~shown, F.col("n"))), F.lit(0)).alias("hidden_events"), F.coalesce(F.sum(F.when(~F.col("_open"), F.col("n"))), F.lit(0)).alias("hidden_console"))


def event_text(text: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(text, F.lit(" (x"), n.cast("string"), F.lit(")"))).otherwise(text)


def as_of(left: DataFrame, right: DataFrame, on: list[str], value: str, bucket: str = "day") -> DataFrame:
    """``left`` with ``value``, a column of ``right``, of the last right row at or before ``ts``
    of equal ``on``; of rows at one time the greatest counts. Null where there is none.

    No pairs are made: both sides are sorted together by key, bucket of time and time, and
    what a bucket ends with is carried to the next ones, so a hot key spreads over its buckets.
    """
    mine = left.columns
    kind = right.schema[value].dataType.simpleString()
    v = F.struct(F.col("ts").alias("at"), F.col(value).alias("value"))
    rows = left.select(*on, "ts", F.struct(*mine).alias("_l"), F.lit(None).cast(f"struct<at:timestamp,value:{kind}>").alias("_v"))
    rows = rows.unionByName(right.select(*on, "ts", F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), v.cast(f"struct<at:timestamp,value:{kind}>").alias("_v"))).withColumn("_b", F.date_trunc(bucket, "ts"))
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(*on, "_b").orderBy("ts", F.col("_l").isNotNull(), "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = rows.groupBy(*on, "_b").agg(F.max("_v").alias("_v"))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("_c", before).where("_c is not null").select(*on, "_b", "_c")
    out = rows.withColumn("_i", inside).where("_l is not null").join(carried, [*on, "_b"], "left")
    return out.withColumn("_f", F.coalesce("_i", "_c")).select("_l.*", F.col("_f.value").alias(value), F.col("_f.at").alias(f"{value}_at"))


def status_as_of(captures: DataFrame, requests: DataFrame) -> DataFrame:
    """``captures`` (session_id, capture_id, document, ts) with the status of the last Document
    request for the address at or before the capture."""
    r = requests.where("kind = 'Document'").select("session_id", F.substring_index("url", "#", 1).alias("_page"), "ts", "status")
    return as_of(captures.withColumn("_page", F.substring_index("document", "#", 1)), r, ["session_id", "_page"], "status").drop("_page", "status_at")


def failure_cause(failed: DataFrame, failures: DataFrame) -> DataFrame:
    """``failed`` (request_id, hostport, ts, since) with the latest connection failure to the
    same host and port between ``since`` and ``ts``."""
    last = as_of(failed, failures.select("hostport", "ts", "cause"), ["hostport"], "cause")
    return last.withColumn("cause", F.when(F.col("cause_at") >= F.col("since"), F.col("cause"))).drop("cause_at")


def refusals(documents: DataFrame, grace: str = "8 seconds") -> DataFrame:
    """(session_id, document, ts, status) of refused documents, once each; one replaced within
    ``grace`` was an automatic check."""
    following = F.lead("ts").over(Window.partitionBy("session_id").orderBy("ts", "document"))
    out = documents.withColumn("_next", following).where(F.col("status").isin(*REFUSALS))
    real = out.where(F.col("_next").isNull() | (F.col("_next") > F.col("ts") + F.expr(f"interval {grace}")))
    return real.groupBy("session_id", "document").agg(F.min_by("status", "ts").alias("status"), F.min("ts").alias("ts"))


def challenge_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (text, status, big_frame, slider, tiles) with ``challenge``: wording, little
    text, and a refusal or a widget."""
    from folioscan.functions.text import has_phrase

    widget = F.coalesce("big_frame", F.lit(False)) | F.coalesce("slider", F.lit(False)) | (F.coalesce("tiles", F.lit(0)) >= 6)
    return pages.withColumn("challenge", has_phrase(F.col("text")) & (F.char_length("text") <= 600) & (F.col("status").isin(*REFUSALS) | widget))


def bursts(events: DataFrame, gap: Column | str = "250 milliseconds") -> DataFrame:
    """(session_id, start, end, n): activity bursts that end after a quiet gap."""
    w = F.session_window("ts", gap)
    out = events.groupBy("session_id", w.alias("w")).agg(F.count("*").alias("n"))
    return out.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def settle_gap(kind: Column) -> Column:
    """Quiet needed after an event: longer after a load or an action."""
    return F.when(kind == "load", "2 seconds").when(kind == "action", "600 milliseconds").otherwise("250 milliseconds")


def toasts(added: DataFrame, removed: DataFrame, within: str = "10 seconds") -> DataFrame:
    """(session_id, text, shown_at) of elements added and removed within the interval; equal
    texts of one session and minute count once."""
    a, r = added.alias("a"), removed.alias("r")
    on = (F.col("a.session_id") == F.col("r.session_id")) & (F.col("a.node") == F.col("r.node")) & (F.col("r.ts") >= F.col("a.ts")) & (F.col("r.ts") <= F.col("a.ts") + F.expr(f"interval {within}"))
    pairs = a.join(r, on).select("a.session_id", "a.text", "a.ts")
    return pairs.groupBy("session_id", "text", F.window("ts", "1 minute").alias("w")).agg(F.min("ts").alias("shown_at")).drop("w")


def wait_results(waits: DataFrame, captures: DataFrame, patience: str = "15 seconds") -> DataFrame:
    """``waits`` (wait_id, session_id, ts, needle, gone) with the first capture within
    ``patience`` whose text holds the needle, or does not where ``gone``; null on time-out.
    Waits meet only the captures of their own stretch of ``patience`` and of the next."""
    width = F.expr(f"unix_micros(timestamp_seconds(0) + interval {patience})")
    slot = lambda ts: F.floor(F.unix_micros(ts.cast("timestamp")) / width)
    c = captures.select("session_id", F.col("ts").alias("_ts"), slot(F.col("ts")).alias("_slot"), "text")
    asked = waits.withColumn("_slot", F.explode(F.array(slot(F.col("ts")), slot(F.col("ts")) + 1)))
    hit = asked.join(c, ["session_id", "_slot"]).where((F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= F.col("ts") + F.expr(f"interval {patience}")) & (F.col("text").contains(F.col("needle")) != F.col("gone")))
    return waits.join(hit.groupBy("wait_id").agg(F.min("_ts").alias("met_at")), "wait_id", "left")


def expectations(checks: DataFrame, captures: DataFrame) -> DataFrame:
    """``checks`` (check_id, session_id, ts, kind, operand) judged against the capture in force:
    kind is url-matches, url-is, text, gone or visible."""
    out = as_of(checks, captures.select("session_id", "ts", F.struct("url", "text").alias("page")), ["session_id"], "page").drop("page_at")
    met = F.when(F.col("kind") == "url-matches", F.expr("page.url rlike operand")).when(F.col("kind") == "url-is", F.col("page.url") == F.col("operand")).when(F.col("kind") == "gone", ~F.contains("page.text", "operand")).otherwise(F.contains("page.text", "operand"))
    return out.withColumn("met", F.coalesce(met, F.lit(False))).drop("page")
