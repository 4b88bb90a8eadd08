"""Receipt-shaped tables derived by Spark from the given event, order and conversation tables.

Each table is a SQL text in the dialect both engines share, but for the names after @; the queries read it
through Spark, the checks through DuckDB. Sums, heights and hashes are integers and strings, so both agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


_CORE = """
SELECT event_id, user_id, event_type AS kind, value, ts,
  'r-' || lpad(CAST(event_id AS STRING), 10, '0') AS receipt_id,
  CASE WHEN user_id % 10 < 4 THEN 'tenant-0' ELSE 'tenant-' || CAST(user_id % 10 AS STRING) END AS tenant_id,
  'u-' || CAST(user_id AS STRING) AS user_name, 'team-' || CAST(user_id % 6 AS STRING) AS team,
  @ISO(ts) AS captured_at, CAST(ts AS DATE) AS captured_day,
  CASE WHEN event_id % 11 < 3 THEN 'anthropic' WHEN event_id % 11 < 7 THEN 'openai' WHEN event_id % 11 < 9 THEN 'google' WHEN event_id % 11 = 9 THEN 'mistral' END AS vendor,
  CASE event_id % 11 WHEN 0 THEN 'claude-opus-4-6' WHEN 1 THEN 'claude-sonnet-4-6' WHEN 2 THEN 'claude-haiku-4-5' WHEN 3 THEN 'gpt-5' WHEN 4 THEN 'gpt-5-mini' WHEN 5 THEN 'gpt-5-nano'
    WHEN 6 THEN 'gpt-4o' WHEN 7 THEN 'gemini-2-5-pro' WHEN 8 THEN 'gemini-2-5-flash' WHEN 9 THEN 'mistral-large' END AS model,
  'app-' || CAST(event_id % 5 AS STRING) AS app, 'uc-' || CAST(event_id % 9 AS STRING) AS use_case_id,
  CASE WHEN event_id % 10 < 7 THEN 'production' WHEN event_id % 10 < 9 THEN 'staging' ELSE 'development' END AS environment,
  'ai.' || event_type AS event_type,
  CASE WHEN event_id % 11 = 10 THEN 0 ELSE (100 + CAST(floor(value * 40) AS BIGINT)) * CASE WHEN event_id % 5 = 4 THEN 3 ELSE 1 END END AS input_tokens,
  CASE WHEN event_id % 11 = 10 THEN 0 ELSE (20 + CAST(floor(value * 7) AS BIGINT)) * CASE WHEN event_id % 5 = 3 THEN 5 ELSE 1 END END AS output_tokens,
  CASE event_id % 7 WHEN 0 THEN 'block' WHEN 1 THEN 'flag' WHEN 2 THEN 'require-approval' WHEN 3 THEN 'allow' END AS decision,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 7 = 0 THEN 'guardrail_block' ELSE 'success' END AS outcome,
  CASE event_id % 4 WHEN 0 THEN @LIST('GDPR_ARTICLE_22') WHEN 1 THEN @LIST('EU_AI_ACT_ART50', 'GDPR_ARTICLE_22') WHEN 2 THEN @LIST('EU_AI_ACT_ART50') ELSE CAST(@LIST() AS @STRINGS) END AS applied_policies,
  CASE event_id % 6 WHEN 0 THEN 'rev-1' WHEN 1 THEN 'pending' END AS reviewer,
  CASE event_id % 6 WHEN 0 THEN 'pii' WHEN 1 THEN 'pci' WHEN 2 THEN 'mnpi' WHEN 3 THEN 'internal' WHEN 4 THEN 'public' ELSE 'pii_redacted' END AS input_class,
  CASE (event_id + 3) % 13 WHEN 0 THEN 'pii' WHEN 1 THEN 'pci' WHEN 2 THEN 'mnpi' WHEN 4 THEN 'public' WHEN 5 THEN 'pii_redacted' ELSE 'internal' END AS output_class,
  event_id % 3 AS evidence_refs, 20 + CAST(floor(value * 4) AS BIGINT) AS latency_ms, event_id % 50 <> 0 AS signed, 'kid-' || CAST(event_id % 4 AS STRING) AS kid
FROM {events}
"""
_HEIGHT = f"SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, event_id) AS chain_height FROM ({_CORE}) AS core"
_HASH = f"SELECT *, @SHA(tenant_id || '|' || CAST(chain_height AS STRING) || '|' || receipt_id) AS receipt_hash FROM ({_HEIGHT}) AS height"
_FLAT = f"""
SELECT *,
  CASE WHEN event_id % 499 = 0 THEN repeat('f', 64) ELSE coalesce(lag(receipt_hash) OVER (PARTITION BY tenant_id ORDER BY chain_height), repeat('0', 64)) END AS previous_receipt_hash,
  CASE WHEN event_id % 211 = 0 THEN 'wf-tenant-0-0' ELSE 'wf-' || tenant_id || '-' || CAST(CAST(floor((chain_height - 1) / 5.0) AS BIGINT) AS STRING) END AS workflow_id,
  CASE WHEN event_id % 97 = 0 THEN 'r-missing' WHEN (chain_height - 1) % 5 <> 0 THEN lag(receipt_id) OVER (PARTITION BY tenant_id ORDER BY chain_height) END AS parent_id
FROM ({_HASH}) AS hashed
"""
#: The same rows by Spark without a window over a whole tenant: heights count on from those of the hours before, and what
#: precedes the first receipt of an hour is the last one of the tenant's hour before it. Hours of a tenant are few rows.
_CELLED = f"""
WITH celled AS (SELECT *, CAST(floor(unix_timestamp(CAST(ts AS TIMESTAMP)) / 3600) AS BIGINT) AS cell FROM ({_CORE}) AS core),
hours AS (SELECT tenant_id, cell, count(*) AS n, max_by(receipt_id, struct(ts, event_id)) AS last_id FROM celled GROUP BY tenant_id, cell),
bases AS (SELECT tenant_id, cell, coalesce(sum(n) OVER (PARTITION BY tenant_id ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, lag(last_id) OVER (PARTITION BY tenant_id ORDER BY cell) AS before_id FROM hours),
placed AS (SELECT c.*, CAST(base + row_number() OVER (PARTITION BY c.tenant_id, c.cell ORDER BY ts, event_id) AS INT) AS chain_height, coalesce(lag(receipt_id) OVER (PARTITION BY c.tenant_id, c.cell ORDER BY ts, event_id), before_id) AS before
  FROM celled AS c JOIN bases AS b ON c.tenant_id <=> b.tenant_id AND c.cell <=> b.cell)
SELECT * EXCEPT (cell, before), @SHA(tenant_id || '|' || CAST(chain_height AS STRING) || '|' || receipt_id) AS receipt_hash,
  CASE WHEN event_id % 499 = 0 THEN repeat('f', 64) ELSE coalesce(@SHA(tenant_id || '|' || CAST(chain_height - 1 AS STRING) || '|' || before), repeat('0', 64)) END AS previous_receipt_hash,
  CASE WHEN event_id % 211 = 0 THEN 'wf-tenant-0-0' ELSE 'wf-' || tenant_id || '-' || CAST(CAST(floor((chain_height - 1) / 5.0) AS BIGINT) AS STRING) END AS workflow_id,
  CASE WHEN event_id % 97 = 0 THEN 'r-missing' WHEN (chain_height - 1) % 5 <> 0 THEN before END AS parent_id
FROM placed
"""
_WORKLOADS = """
SELECT CASE l_partkey % 12 WHEN 0 THEN 'claude-opus-4-6-20260501' WHEN 1 THEN 'claude-sonnet-4-6' WHEN 2 THEN 'claude-haiku-4.5' WHEN 3 THEN 'gpt-5-2025-08-01' WHEN 4 THEN 'gpt-5-mini'
    WHEN 5 THEN 'GPT-5-nano-2025' WHEN 6 THEN 'gpt-4o' WHEN 7 THEN 'gemini-2.5-pro' WHEN 8 THEN 'gemini-2.5-flash' WHEN 9 THEN 'mistral-large' WHEN 10 THEN 'gpt-5-pro' ELSE 'claude-opus-4-6-thinking' END AS raw_model,
  'app-' || CAST(l_suppkey % 20 AS STRING) AS app, CAST(l_quantity AS BIGINT) AS requests, CAST(floor(l_extendedprice) AS BIGINT) AS input_total,
  CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS output_total, @ISO(l_shipdate) AS at_iso, l_orderkey, l_linenumber
FROM {lineitem}
"""
_CASCADES = """
SELECT 'run-' || CAST(o_orderkey AS STRING) AS run_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'extract' WHEN 1 THEN 'translate' WHEN 2 THEN 'summarize' WHEN 3 THEN 'code' WHEN 4 THEN 'analyze' WHEN 5 THEN 'creative' ELSE 'unknown' END AS intent,
  CAST(floor(o_totalprice / 100) AS BIGINT) AS planner_in, CAST(floor(o_totalprice / 1000) AS BIGINT) AS planner_out,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice / 50) AS BIGINT) END AS executor_in,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice / 400) AS BIGINT) END AS executor_out,
  o_orderstatus = 'F' AS approved, @ISO(o_orderdate) AS at_iso,
  CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk, o_orderkey % 500 AS estimated_input_tokens
FROM {orders}
"""
_VERDICTS = """
SELECT 'a-' || CAST(l_orderkey AS STRING) AS action_hash, 'tenant-' || CAST(l_orderkey % 4 AS STRING) AS tenant_id, l_linenumber AS line, 'kid-' || CAST(l_suppkey % 5 AS STRING) AS kid,
  'p-' || CAST(l_suppkey % 7 AS STRING) AS reviewer, CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'N' THEN 'concerns' ELSE 'reject' END AS verdict, @ISO(l_shipdate) AS expires_at, l_shipdate AS decided_ts
FROM {lineitem}
"""
_ACTIONS = """
SELECT 'a-' || CAST(o_orderkey AS STRING) AS action_hash, 'tenant-' || CAST(o_orderkey % 4 AS STRING) AS tenant_id, 'p-' || CAST(o_custkey % 7 AS STRING) AS actor, o_orderdate AS requested_ts FROM {orders}
"""
_PAIRS = """
SELECT conv_id, turn, text AS input_text, answer AS output_text FROM (
  SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM {conversations}) AS paired
WHERE role = 'user' AND next_role = 'assistant'
"""
_FILES = """
SELECT coalesce(source, 'none') AS dataset_id, coalesce(source, 'none') || '/' || CAST(doc_id AS STRING) AS path, n_chars AS size_bytes, @SHA(coalesce(text, '')) AS sha256 FROM {documents}
"""
_TEXTS = {"receipts": _FLAT, "core": _CORE, "workloads": _WORKLOADS, "cascade_runs": _CASCADES, "verdicts": _VERDICTS, "actions": _ACTIONS, "prompt_pairs": _PAIRS, "dataset_files": _FILES}
_SOURCES = {"receipts": "events", "core": "events", "workloads": "lineitem", "cascade_runs": "orders", "verdicts": "lineitem", "actions": "orders", "prompt_pairs": "conversations", "dataset_files": "documents"}


def _calls(text: str, name: str, before: str, after: str) -> str:
    """Replaces name(argument) by before argument after."""
    while (at := text.find(name + "(")) >= 0:
        depth, end = 0, at + len(name)
        while True:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            if not depth:
                break
            end += 1
        text = text[:at] + before + text[at + len(name) + 1 : end] + after + text[end + 1 :]
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _CELLED if name == "receipts" else _TEXTS[name]
    text = _calls(_calls(text, "@SHA", "sha2(", ", 256)"), "@ISO", "date_format(", ", \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    text = text.replace("@LIST", "array").replace("@STRINGS", "array<string>")
    source = _SOURCES[name]
    return spark.sql(text, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipts without their place in the chain (heights, links, workflows): one pass over the events, no exchange."""
    return table(spark, sf_dir, "core")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat receipt for each event; null parent_id: the first step of its workflow."""
    return table(spark, sf_dir, "receipts")


def cte(name: str) -> str:
    text = _calls(_calls(_TEXTS[name], "@SHA", "sha256(", ")"), "@ISO", "strftime(", ", '%Y-%m-%dT%H:%M:%SZ')")
    text = text.replace("@LIST", "list_value").replace("@STRINGS", "VARCHAR[]")
    return f"{name} AS ({text.replace('{' + _SOURCES[name] + '}', _SOURCES[name])})"
