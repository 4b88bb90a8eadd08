"""Readers and writers for receipts, usage exports and evidence packs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPT = """receipt struct<schema_version string, receipt_id string, tenant_id string, issued_at string,
  event struct<schema_version string, tenant_id string, event_type string, source_system string, event_id string, captured_at string,
    context struct<user_id string, session_id string, service_id string, environment string, region string, correlation_id string, team string>,
    subject struct<ai_vendor string, ai_model string, ai_model_version string, ai_provider string, ai_capability string>,
    payload struct<input_hash string, input_classification string, input_token_count bigint, output_hash string, output_classification string, output_token_count bigint, metadata string>>,
  decision struct<policy_bundle_hash string, applied_policies array<string>, decision string, reason_codes array<string>>,
  provenance struct<parent_receipt_ids array<string>, workflow_id string>,
  evidence_refs array<struct<kind string, hash string, uri string>>,
  integrity struct<previous_receipt_hash string, receipt_hash string, chain_height bigint, merkle_period string>>,
 signatures array<struct<alg string, kid string, sig string>>, timestamps array<struct<tsa string, timestamp_token string>>, _bad string"""


def read_receipts(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """Receipts of JSON files below paths; other or unreadable JSON is left out.

    A file is one JSON value, whose array is flattened, or with `lines` one value a line, which Spark also splits.
    """
    reader = spark.read.schema(RECEIPT).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    rows = reader.option("multiLine", str(not lines).lower()).json(list(paths))
    return rows.where("receipt is not null and signatures is not null").drop("_bad")


def read_receipt_store(rows: DataFrame) -> DataFrame:
    """The stored table (receipt_id, tenant_id, chain_height, body: JSON text) with vendor, model, team and decision promoted."""
    at = lambda path: F.get_json_object("body", path)
    return rows.select(
        "receipt_id", "tenant_id", "chain_height", at("$.event.subject.ai_vendor").alias("vendor"), at("$.event.subject.ai_model").alias("model"),
        F.coalesce(at("$.event.context.team"), F.lit("Unknown")).alias("team"), at("$.decision.decision").alias("decision"), at("$.event.payload.input_token_count").cast("bigint").alias("input_tokens"),
    )


EXPORT = """snapshot_id string, model string, model_id string, n_requests double, requests double, count double, n_context_tokens_total double, input_tokens double, prompt_tokens double, context_tokens double,
  n_generated_tokens_total double, output_tokens double, completion_tokens double, generated_tokens double, api_key_name string, workspace string, project string, project_id string, api_key string, app string,
  aggregation_timestamp string, date string, timestamp string, bucket string"""


def usage_rows(documents: DataFrame) -> DataFrame:
    """Bill rows (raw_model, app, requests, input_total, output_total, at_iso) of documents (text): a JSON array, or one under data, usage or results.

    Of the candidates for a field, the first text that isn't blank and the first number above 0 count; rows without requests go.
    """
    rows = F.coalesce(F.from_json("text", f"array<struct<{EXPORT}>>"), F.array().cast(f"array<struct<{EXPORT}>>"))
    wrapped = F.from_json("text", f"data array<struct<{EXPORT}>>, usage array<struct<{EXPORT}>>, results array<struct<{EXPORT}>>")
    listed = F.ltrim("text").startswith("[")
    r = documents.withColumn("_w", wrapped).select(F.explode(F.when(listed, rows).otherwise(F.coalesce("_w.data", "_w.usage", "_w.results"))).alias("r")).where("r is not null").select("r.*")
    first_text = lambda *names: F.coalesce(*[F.when(F.trim(n) != "", F.col(n)) for n in names])
    first_number = lambda *names: F.coalesce(*[F.when(F.col(n) > 0, F.col(n)) for n in names], F.lit(0.0)).cast("bigint")
    out = r.select(
        F.coalesce(first_text("snapshot_id", "model", "model_id"), F.lit("")).alias("raw_model"),
        F.coalesce(first_text("api_key_name", "workspace", "project", "project_id", "api_key", "app"), F.lit("unknown")).alias("app"),
        first_number("n_requests", "requests", "count").alias("requests"),
        first_number("n_context_tokens_total", "input_tokens", "prompt_tokens", "context_tokens").alias("input_total"),
        first_number("n_generated_tokens_total", "output_tokens", "completion_tokens", "generated_tokens").alias("output_total"),
        instant(F.coalesce("aggregation_timestamp", "date", "timestamp", "bucket")).alias("at_iso"),
    )
    return out.where("requests > 0")


def instant(x: Column) -> Column:
    """Epoch seconds (below 1e12) or milliseconds, a day (its noon) or a timestamp, as UTC text; else the epoch."""
    number = F.expr("NULL").cast("double") if x is None else F.when(x.rlike(r"^[0-9]+(\.[0-9]+)?$"), x.cast("double"))
    millis = F.when(number < 1e12, number * 1000).otherwise(number).cast("bigint")
    parsed = F.coalesce(F.timestamp_millis(millis), F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(x, F.lit("T12:00:00Z")))), F.try_to_timestamp(x), F.timestamp_millis(F.lit(0)))
    return F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def read_usage_export(spark: SparkSession, path: str) -> DataFrame:
    return usage_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def write_export_jsonl(events: DataFrame, path: str) -> None:
    """One JSON line for each event."""
    events.write.mode("overwrite").json(path)


def write_evidence_pack(path: str, tenant: str, since: str, until: str, **parts: DataFrame) -> None:
    """A directory with a part for each table, partitioned by tenant: the rows of one tenant and period.

    Tables with captured_at are cut to the period; those without a tenant (keys) are written whole.
    """
    for name, df in parts.items():
        if "captured_at" in df.columns:
            df = df.where((F.col("captured_at") >= since) & (F.col("captured_at") < until))
        if "tenant_id" in df.columns:
            df.where(F.col("tenant_id") == tenant).write.mode("overwrite").partitionBy("tenant_id").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def export_fanout(batch: DataFrame, sinks: list[Callable[[DataFrame], None]], attempts: int = 3) -> list[tuple[int, bool, int, str | None]]:
    """Delivers one batch to several sinks; each is tried `attempts` times, and none holds up another. (place, ok, delivered, error) of each.

    A sink that writes by batch id (streaming.sinks.write_once) takes a batch once, whether an attempt or the whole batch runs again.
    """
    held = batch.persist()
    try:
        n, report = held.count(), []
        for place, sink in enumerate(sinks):
            error: str | None = None
            for _ in range(attempts):
                try:
                    sink(held)
                    error = None
                    break
                except Exception as e:  # noqa: BLE001
                    error = str(e)
            report.append((place, error is None, n if error is None else 0, error))
        return report
    finally:
        held.unpersist()
