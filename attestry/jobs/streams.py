"""Streaming jobs over the derived receipts, drained once; their SQL checks state the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.jobs.catalog import query
from attestry.jobs.spend import _PRICED, priced
from attestry.jobs.texts import raw_events
from attestry.sources import receipts
from attestry.streaming import jobs as op
from attestry.streaming import sinks


def timed(spark, sf_dir):
    """Priced receipts with a session-zone timestamp for watermarks."""
    return priced(spark, sf_dir, chain=True).select("receipt_id", "event_id", "tenant_id", F.col("ts").cast("timestamp").alias("ts"), "captured_at", "outcome", "input_tokens", "output_tokens", "nano", "chain_height", "receipt_hash", "previous_receipt_hash", "user_name", "kind")


# The last window(s) stay open: a window is emitted once the watermark (one hour behind the newest of the batches before) has passed its end.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM receipts)"


@query("stream_windows", _PRICED + f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%dT%H:%M:%S') AS window_start, tenant_id, count(*) AS receipts, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(coalesce(nano, 0)) AS BIGINT) AS nano
  FROM priced GROUP BY ALL HAVING time_bucket(INTERVAL 5 MINUTE, min(ts)) + INTERVAL 5 MINUTE <= {_CLOSED}""", "receipts", "pricing")
def stream_windows(spark, sf_dir):
    return op.in_slices(timed(spark, sf_dir), op.stream_windows, on_disk=False)


@query("stream_rate_alerts", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS start, count(*) AS receipts, count(*) FILTER (outcome = 'error') AS errors FROM receipts, range(5) AS t(k) GROUP BY 1)
SELECT strftime(start, '%Y-%m-%dT%H:%M:%S') AS window_start, receipts, errors FROM w WHERE errors > 0.3 * receipts AND start + INTERVAL 5 MINUTE <= {_CLOSED}""", "receipts")
def stream_rate_alerts(spark, sf_dir):
    return op.in_slices(timed(spark, sf_dir), lambda rows: op.stream_rate_alerts(rows, 0.3), on_disk=False)


@query("stream_ingest", """SELECT receipt_id, event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 107 <> 0 AND event_id % 109 <> 0 AND event_id % 113 <> 0 AND event_id % 127 <> 0 AND event_id % 131 <> 0 AND event_id % 137 <> 0 AND event_id % 139 <> 0 AS accepted FROM receipts""", "receipts")
def stream_ingest(spark, sf_dir):
    base = op.folder(spark)
    events = raw_events(spark, sf_dir).withColumn("n", F.substring("receipt_id", 3, 10).cast("long"))
    op.in_slices(events, lambda rows: op.stream_ingest(rows, f"{base}/good", f"{base}/bad", f"{base}/state"), order="n")
    read = lambda name: sinks.read_once(spark, f"{base}/{name}", "receipt_id string")
    return read("good").withColumn("accepted", F.lit(True)).unionByName(read("bad").withColumn("accepted", F.lit(False)))


@query("stream_dedup", "SELECT count(*) AS receipts, count(DISTINCT receipt_id) AS distinct_receipts FROM receipts", "receipts")
def stream_dedup(spark, sf_dir):
    """Every twentieth capture comes twice within the day; each is kept once."""
    rows = priced(spark, sf_dir).select("receipt_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("req-"), "receipt_id").alias("request_id"))
    twice = rows.unionByName(rows.where("event_id % 20 = 0").withColumn("ts", F.col("ts") + F.expr("interval 5 seconds")))
    kept = op.in_slices(twice, op.stream_dedup)
    return kept.agg(F.count(F.lit(1)).alias("receipts"), F.countDistinct("receipt_id").alias("distinct_receipts"))


@query("stream_dedup_rows", "SELECT receipt_id, 1 AS kept FROM receipts", "receipts")
def stream_dedup_rows(spark, sf_dir):
    """Every twentieth capture comes again after 5 seconds and every 45th after 23 hours: how often each receipt is kept."""
    rows = priced(spark, sf_dir).select("receipt_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("req-"), "receipt_id").alias("request_id"))
    again = [rows.where(f"event_id % {every} = 0").withColumn("ts", F.col("ts") + F.expr(f"interval {after}")) for every, after in ((20, "5 seconds"), (45, "23 hours"))]
    kept = op.in_slices(rows.unionByName(again[0]).unionByName(again[1]), op.stream_dedup, on_disk=False)
    return kept.groupBy("receipt_id").agg(F.count(F.lit(1)).cast("int").alias("kept"))


@query("stream_late_rows", """WITH came AS (SELECT receipt_id, epoch(ts) AS t, epoch(ts) + CASE WHEN event_id % 37 = 0 THEN 432000 WHEN event_id % 41 = 0 THEN 1800 ELSE 0 END AS came_s FROM receipts),
ends AS (SELECT min(came_s) AS low, (max(came_s) - min(came_s)) / 4 AS width FROM came), put AS (SELECT *, CAST(least(3, floor((came_s - low) / width)) AS INT) AS slice FROM came, ends),
marks AS (SELECT slice, max(t) - 3600 AS mark FROM put GROUP BY 1)
SELECT receipt_id, coalesce(t <= (SELECT max(mark) FROM marks m WHERE m.slice < put.slice), false) AS late FROM put""", "receipts")
def stream_late_rows(spark, sf_dir):
    """Every 37th receipt comes five days after its time, every 41st half an hour: what the gate lets through, and what it puts aside."""
    base = op.folder(spark)
    delay = F.when(F.col("event_id") % 37 == 0, 432_000).when(F.col("event_id") % 41 == 0, 1800).otherwise(0)
    rows = receipts.core(spark, sf_dir).select("receipt_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("ts").cast("timestamp").cast("double") + delay).alias("came_s"))
    op.in_slices(rows, lambda stream: op.drain(stream, sinks.gate(base), f"{base}/state"), order="came_s")
    read = lambda name: sinks.read_once(spark, f"{base}/{name}", "receipt_id string")
    return read("main").withColumn("late", F.lit(False)).unionByName(read("side").withColumn("late", F.lit(True)))


@query("stream_conflicts", """SELECT receipt_id AS request_id, receipt_id || '-' || copy AS capture_id, CASE copy WHEN '1' THEN 'accepted' WHEN '2' THEN 'replay' WHEN '3' THEN 'conflict' ELSE 'accepted' END AS verdict
  FROM receipts, (VALUES ('1'), ('2'), ('3'), ('4')) AS c(copy) WHERE copy = '1' OR (copy = '2' AND event_id % 20 = 0) OR (copy = '3' AND event_id % 45 = 0) OR (copy = '4' AND event_id % 33 = 0)""", "receipts")
def stream_conflicts(spark, sf_dir):
    """Captures that come again: with the same body after 5 seconds, with another after 7, and with the same after a day and an hour."""
    rows = receipts.receipts(spark, sf_dir).select("receipt_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "receipt_hash")
    each = [("1", 1, 0, "receipt_hash"), ("2", 20, 5, "receipt_hash"), ("3", 45, 7, "receipt_id"), ("4", 33, 25 * 3600, "receipt_hash")]
    copies = [
        rows.where(f"event_id % {every} = 0").select(F.col("receipt_id").alias("request_id"), F.concat_ws("-", "receipt_id", F.lit(n)).alias("capture_id"), F.col(body).alias("body_hash"), (F.col("ts") + F.expr(f"interval {after} seconds")).alias("ts"))
        for n, every, after, body in each
    ]
    return op.in_slices(copies[0].unionByName(copies[1]).unionByName(copies[2]).unionByName(copies[3]), op.stream_conflicts, flush="2 hours")


@query("stream_chain", "SELECT tenant_id, CAST(chain_height AS BIGINT) AS chain_height, CASE WHEN event_id % 499 = 0 THEN 'broken' ELSE 'ok' END AS verdict FROM receipts", "receipts")
def stream_chain(spark, sf_dir):
    rows = receipts.receipts(spark, sf_dir).select("tenant_id", F.col("ts").cast("timestamp").alias("ts"), "chain_height", "receipt_hash", "previous_receipt_hash")
    return op.in_slices(rows, op.stream_chain, flush="2 hours")


@query("stream_budget", _PRICED + """, s AS (SELECT tenant_id, captured_at[1:7] AS month, captured_at, event_id, CAST(sum(coalesce(nano, 0)) OVER (PARTITION BY tenant_id, captured_at[1:7] ORDER BY captured_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent_nano FROM priced),
a AS (SELECT *, CASE WHEN spent_nano >= 20000000000 THEN 'deny' WHEN spent_nano >= 18000000000 THEN 'throttle' WHEN spent_nano >= 15000000000 THEN 'warn' ELSE 'allow' END AS action FROM s),
l AS (SELECT *, lag(action, 1, 'allow') OVER (PARTITION BY tenant_id, month ORDER BY captured_at, event_id) AS last FROM a) SELECT tenant_id, month, action, spent_nano FROM l WHERE action <> last""", "receipts", "pricing")
def stream_budget(spark, sf_dir):
    return op.in_slices(timed(spark, sf_dir), lambda rows: op.stream_budget(rows, 20_000_000_000), flush="2 hours")


@query("stream_prompt_cache", """WITH RECURSIVE e AS (SELECT user_name || '|' || kind AS k, kind, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_name, kind ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS r FROM receipts),
run AS (SELECT k, kind, r, t AS stored, false AS hit FROM e WHERE r = 1 UNION ALL SELECT e.k, e.kind, e.r, CASE WHEN e.t - run.stored < 86400 THEN run.stored ELSE e.t END, e.t - run.stored < 86400 FROM run JOIN e ON e.k = run.k AND e.r = run.r + 1)
SELECT kind, count(*) AS calls, count(*) FILTER (hit) AS hits FROM run GROUP BY 1""", "receipts")
def stream_prompt_cache(spark, sf_dir):
    """Prompts keyed by user and event kind; the hit rate per kind."""
    ts = F.col("ts").cast("timestamp")
    rows = receipts.core(spark, sf_dir).select(F.concat_ws("|", "user_name", "kind").alias("prompt_key"), "event_id", F.unix_timestamp(ts).alias("at_s"), ts.alias("ts"))
    found = op.in_slices(rows, lambda x: op.stream_prompt_cache(x, ttl_seconds=86_400), flush="2 hours")
    return found.groupBy(F.substring_index("prompt_key", "|", -1).alias("kind")).agg(F.count(F.lit(1)).alias("calls"), F.count_if("hit").alias("hits"))


@query("stream_approvals", """WITH req AS (SELECT action_hash AS request, requested_ts, requested_ts + INTERVAL 60 DAY AS deadline FROM actions),
dec AS (SELECT d.action_hash AS request, reviewer, CASE WHEN verdict = 'reject' THEN 'reject' ELSE 'approve' END AS decision, decided_ts AS ts, line AS seq, deadline FROM verdicts d JOIN req ON request = d.action_hash),
one AS (SELECT *, row_number() OVER (PARTITION BY request, reviewer ORDER BY ts, seq) AS r FROM dec WHERE ts < deadline),
ran AS (SELECT *, count(*) FILTER (decision = 'approve') OVER w AS yes, count(*) FILTER (decision = 'reject') OVER w AS no FROM one WHERE r = 1 WINDOW w AS (PARTITION BY request ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
fin AS (SELECT request, CASE WHEN no > 0 THEN 'rejected' ELSE 'approved' END AS status, seq, row_number() OVER (PARTITION BY request ORDER BY ts, seq) AS k FROM ran WHERE no > 0 OR yes >= 2),
mark AS (SELECT greatest((SELECT max(requested_ts) FROM req), (SELECT max(ts) FROM dec WHERE ts < deadline)) - INTERVAL 1 DAY AS last)
SELECT req.request, coalesce(status, 'expired') AS status, seq FROM req LEFT JOIN fin ON fin.request = req.request AND k = 1, mark WHERE status IS NOT NULL OR req.deadline < mark.last""", "verdicts", "actions")
def stream_approvals(spark, sf_dir):
    """Requests that expire after 60 days, and the decisions on them, which the tables date up to seven years before; those still open at the last watermark are not told."""
    at = lambda c: F.col(c).cast("timestamp")
    asked = receipts.table(spark, sf_dir, "actions").select(F.col("action_hash").alias("request"), at("requested_ts").alias("ts"), (F.unix_timestamp(at("requested_ts")) + 60 * 86_400).alias("deadline_s"))
    told = receipts.table(spark, sf_dir, "verdicts").select(F.col("action_hash").alias("request"), F.col("reviewer").alias("approver"), F.when(F.col("verdict") == "reject", "reject").otherwise("approve").alias("decision"), at("decided_ts").alias("ts"), F.col("line").cast("long").alias("seq"))
    rows = asked.withColumn("side", F.lit("asked")).unionByName(told.withColumn("side", F.lit("told")), allowMissingColumns=True)
    side = lambda rows, name: rows.where(f"side = '{name}' or side is null")
    found = op.in_slices(rows, lambda rows: op.stream_approvals(side(rows, "asked"), side(rows, "told"), early="3000 days"), flush="3100 days")
    newest = asked.agg(F.max("ts").alias("ts")).union(told.join(asked.select("request", "deadline_s"), "request").where("ts < timestamp_seconds(deadline_s)").agg(F.max("ts"))).agg((F.max("ts") - F.expr("interval 1 day")).alias("mark"))
    return found.join(F.broadcast(newest)).where("status <> 'expired' or timestamp_seconds(deadline_s) < mark").select("request", "status", "seq")
