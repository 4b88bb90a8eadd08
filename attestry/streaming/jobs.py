"""The receipt jobs as Structured Streaming queries.

Every function takes a streaming (or static) DataFrame of receipts and returns a DataFrame. `in_slices` feeds a table to
one of them slice by slice, as a job that is run again and again with what has come since: this is how the registered
queries and the tests use them. Watermarks bound all state: windows and joins drop what they have passed; jobs with keyed
state take rows in event-time order as the watermark passes them (`ordered.in_order`), so their answer is that of a batch
over the same rows. Rows later than the watermark are dropped by Spark; `sinks.gate` puts them into a table of their own first.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.tables import shared_dir, written
from attestry.operators.exports import validate_events
from attestry.streaming.decided import FIELDS, NONE, Decided
from attestry.streaming.ordered import in_order, state_on_disk
from attestry.streaming.sinks import write_once


def folder(spark: SparkSession) -> str:
    return shared_dir(spark, "stream")


def in_slices(rows: DataFrame, query: Callable[[DataFrame], DataFrame | None], slices: int = 4, order: str = "ts", flush: str | None = None, on_disk: bool = True) -> DataFrame | None:
    """What a streaming query (append mode) makes of rows that come in slices of equal time, one batch a slice.

    order: a time or number column. A slice is written by as many tasks as hold its rows, and read as one batch of all its
    files; the query stops after each batch and goes on from its checkpoint. A query that returns nothing has its own sink,
    and is called for each slice. flush: a heartbeat follows the last slice, a row of nulls with a ts that much after the
    newest, so that the watermark passes all rows. on_disk: state in RocksDB, which keyed state has always, else as the session has it.
    """
    spark, base = rows.sparkSession, folder(rows.sparkSession)
    place = F.col(order).cast("timestamp").cast("double") if "timestamp" in dict(rows.dtypes)[order] else F.col(order).cast("double")
    staged = written(rows.withColumn("_place", place))
    low, high = staged.agg(F.min("_place"), F.max("_place")).first()
    width = ((high or 0.0) - (low or 0.0)) / slices or 1.0
    part = F.least(F.lit(slices - 1), F.floor((F.coalesce("_place", F.lit(low or 0.0)) - (low or 0.0)) / width))
    staged.where("false").drop("_place").write.mode("append").parquet(f"{base}/in")
    parts = [staged.where(part == k).drop("_place") for k in range(slices)]
    if flush is not None:
        newest = staged.agg((F.max("ts") + F.expr(f"interval {flush}")).alias("ts"))
        parts.append(newest.select(*[F.col("ts").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))
    for one in parts:
        one.write.mode("append").parquet(f"{base}/in")
        with state_on_disk(spark) if on_disk else nullcontext():
            found = query(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        if found is not None:
            with state_on_disk(spark) if on_disk or "TransformWithState" in found._jdf.queryExecution().logical().toString() else nullcontext():
                found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return None if found is None else spark.read.schema(found.schema).parquet(f"{base}/out")


def drain(rows: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs batch(rows, number) on each micro-batch of what is there."""
    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_ingest(events: DataFrame, good: str, bad: str, checkpoint: str) -> None:
    """Capture stream: valid events go to one table, others with their error to another; drains what is there.

    Both tables are keyed by the batch: one that is run again after a failure leaves no second copy.
    """

    def batch(rows: DataFrame, k: int) -> None:
        checked = validate_events(rows).persist()
        write_once(checked.where("error is null").drop("error"), good, k)
        write_once(checked.where("error is not null"), bad, k)
        checked.unpersist()

    drain(events, batch, checkpoint)


def stream_dedup(rows: DataFrame, key: str = "request_id", within: str = "24 hours") -> DataFrame:
    """Replays of a key inside the time are dropped."""
    return rows.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def stream_conflicts(rows: DataFrame, within_seconds: int = 86_400, late: str = "1 hour", groups: int = 64) -> DataFrame:
    """request_id, capture_id, verdict of rows (request_id, capture_id, body_hash, ts): accepted, replay (of the body that was accepted inside the time) or conflict (another body).

    The accepted body is forgotten when the time is over; of captures at one time the lesser capture_id comes first.
    """

    def step(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        key, at, capture, body = row
        if held is None or at - held[1] >= 1000 * within_seconds:
            return (body, at), [(key, capture, "accepted")]
        return held, [(key, capture, "replay" if body == held[0] else "conflict")]

    return in_order(
        rows, "request_id", F.unix_millis("ts"), ["capture_id"], ["body_hash"], step, "request_id string, capture_id string, verdict string", late, expires=lambda held: held[1] + 1000 * within_seconds, groups=groups
    )


def stream_windows(rows: DataFrame, every: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Receipts, tokens and nano-dollars per tenant and tumbling window, once the window has closed."""
    w = F.window("ts", every)
    out = rows.withWatermark("ts", late).groupBy(w.alias("w"), "tenant_id").agg(F.count(F.lit(1)).alias("receipts"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum(F.coalesce("nano", F.lit(0))).alias("nano"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"), "tenant_id", "receipts", "tokens", "nano")


def stream_rate_alerts(rows: DataFrame, threshold: float, span: str = "5 minutes", step: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Sliding windows in which the share of errors is above the threshold."""
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", span, step).alias("w")).agg(F.count(F.lit(1)).alias("receipts"), F.count_if(F.col("outcome") == "error").alias("errors"))
    return out.where(F.col("errors") > threshold * F.col("receipts")).select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"), "receipts", "errors")


def stream_chain(rows: DataFrame, late: str = "1 hour", groups: int = 64) -> DataFrame:
    """tenant_id, chain_height, verdict (ok, broken, replay, gap) of receipts in event-time order; state: a tenant's height and head.

    Receipts that come early wait until the watermark has passed them. Heights that are missing then are a gap, told once
    at the last missing one, and the receipt after it is broken, as its predecessor isn't known.
    """

    def step(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        tenant, _, height, own, last = row
        known, head = held or (0, "0" * 64)
        if height <= known:
            return (known, head), [(tenant, height, "replay")]
        gap = [(tenant, height - 1, "gap")] if height > known + 1 else []
        return (height, own), [*gap, (tenant, height, "ok" if last == head and not gap else "broken")]

    slim = rows.select("tenant_id", "ts", F.col("chain_height").cast("long").alias("chain_height"), "receipt_hash", "previous_receipt_hash")
    return in_order(slim, "tenant_id", F.unix_millis("ts"), ["chain_height"], ["receipt_hash", "previous_receipt_hash"], step, "tenant_id string, chain_height long, verdict string", late, groups=groups)


def stream_budget(rows: DataFrame, limit_nano: int, late: str = "1 hour", groups: int = 64) -> DataFrame:
    """tenant_id, month, action, spent_nano each time that a tenant's action of the month changes, by seconds of captured_at and event_id."""
    levels = ((limit_nano, "deny"), (limit_nano * 9 // 10, "throttle"), (limit_nano * 3 // 4, "warn"), (-1, "allow"))

    def step(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        tenant, _, _, month, nano = row
        spent, last = held[1:] if held and held[0] == month else (0, "allow")
        spent += nano
        action = next(a for least, a in levels if spent >= least)
        return (month, spent, action), [(tenant, month, action, spent)] if action != last else []

    slim = rows.select("tenant_id", "event_id", "ts", F.substring("captured_at", 1, 7).alias("month"), F.coalesce("nano", F.lit(0)).cast("long").alias("nano"))
    return in_order(slim, "tenant_id", F.unix_seconds("ts") * 1000, ["event_id"], ["month", "nano"], step, "tenant_id string, month string, action string, spent_nano long", late, 1000, groups=groups)


def stream_prompt_cache(rows: DataFrame, ttl_seconds: int = 3600, late: str = "1 hour", groups: int = 64) -> DataFrame:
    """prompt_key, event_id, hit: a prompt seen within the time since it was stored is a hit, and doesn't renew it.

    rows: prompt_key, event_id, at_s (whole seconds of ts), ts. An entry is dropped when the watermark has passed its time.
    """

    def step(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        key, at, event = row
        hit = held is not None and at - held[0] < 1000 * ttl_seconds
        return held if hit else (at,), [(key, event, hit)]

    return in_order(rows, "prompt_key", F.col("at_s") * 1000, ["event_id"], [], step, "prompt_key string, event_id long, hit boolean", late, 1000, lambda held: held[0] + 1000 * ttl_seconds, groups)


def stream_approvals(requests: DataFrame, decisions: DataFrame, threshold: int = 2, late: str = "1 day", longest: str = "60 days", early: str = "0 days", groups: int = 128) -> DataFrame:
    """request, deadline_s, status, seq once the watermark has passed a request's time: rejected, approved by enough approvers, or expired (seq null).

    requests: request, ts, deadline_s; decisions: request, approver, decision, ts, seq. A request has the decisions from
    `early` before its own time to before its deadline, at most `longest` after it, which bounds the state of both sides. Of
    an approver the first decision counts; in time order the first rejection rejects, the threshold-th approval before it
    approves; of one time and seq a rejection comes first. State lies on disk by groups of requests (`decided`).
    """
    ts, none = F.col("ts"), F.lit(NONE).cast("long")
    whole = lambda c: F.coalesce(F.col(c).cast("long"), none).alias(c)
    text = F.lit(None).cast("string")
    last = F.least(F.unix_micros(ts + F.expr(f"interval {longest}")), F.col("deadline_s") * 1_000_000 - 1)
    no_time = F.col("deadline_s").isNull()
    first = F.when(no_time, (1 << 63) - 1).otherwise(F.unix_micros(ts - F.expr(f"interval {early}")))
    asked = requests.withWatermark("ts", late).select(
        "request", "ts", F.unix_micros(ts).alias("at"), F.lit(True).alias("asked"), first.alias("low"), F.when(no_time, F.unix_micros(ts)).otherwise(last).alias("high"), whole("deadline_s"), text.alias("approver"), text.alias("decision"), none.alias("seq")
    )
    told = decisions.withWatermark("ts", late).select(
        "request", "ts", F.unix_micros(ts).alias("at"), F.lit(False).alias("asked"), F.unix_micros(ts + F.expr(f"interval {early}")).alias("low"), F.lit(0).cast("long").alias("high"), none.alias("deadline_s"), "approver", "decision", whole("seq")
    )
    # One condition that names ts, else Spark filters before the watermark has seen the heartbeat.
    known = asked.unionByName(told).where("if(request is null, null, ts) is not null")
    slim = known.select(F.pmod(F.xxhash64("request"), F.lit(groups)).cast("int").alias("event_group"), *FIELDS)
    found = slim.groupBy("event_group").transformWithStateInPandas(Decided(threshold), "request string, deadline_s long, status string, seq long", "Append", "EventTime")
    return found.select("request", F.nullif("deadline_s", none).alias("deadline_s"), "status", F.nullif("seq", none).alias("seq"))
