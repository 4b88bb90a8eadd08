"""Small dimensions: prices, energy, tiers, keys, registries, articles. Each is a few dozen rows, made as a local table whose size Spark knows.

Prices are whole nano-dollars a token, which makes every sum of costs an exact integer; dollars appear at the edge.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

# Vendor, model, nano-dollars a token for input, output, cache read and cache write.
PRICING = [
    ("anthropic", "claude-opus-4-6", 15000, 75000, 1500, 18750),
    ("anthropic", "claude-sonnet-4-6", 3000, 15000, 300, 3750),
    ("anthropic", "claude-haiku-4-5", 1000, 5000, 100, 1250),
    ("openai", "gpt-5", 5000, 15000, 0, 0),
    ("openai", "gpt-5-mini", 250, 1000, 0, 0),
    ("openai", "gpt-5-nano", 50, 400, 0, 0),
    ("openai", "gpt-4o", 2500, 10000, 0, 0),
    ("openai", "gpt-4o-mini", 150, 600, 0, 0),
    ("google", "gemini-2-5-pro", 1250, 10000, 0, 0),
    ("google", "gemini-2-5-flash", 75, 300, 0, 0),
    ("aws-bedrock", "claude-sonnet-4-6", 3000, 15000, 0, 0),
]
# Vendor, model, tenths of a watt-hour for 1,000 tokens, grams of CO2e for a kilowatt-hour.
ENERGY = [
    ("anthropic", "claude-opus-4-6", 75, 320),
    ("anthropic", "claude-sonnet-4-6", 25, 320),
    ("anthropic", "claude-haiku-4-5", 8, 320),
    ("openai", "gpt-5", 40, 400),
    ("openai", "gpt-5-mini", 6, 400),
    ("google", "gemini-2-5-pro", 30, 280),
    ("google", "gemini-2-5-flash", 5, 280),
]
# Vendor, premium or mid-tier model, the next cheaper model of that vendor, whether it counts as premium.
TIERS = [
    ("anthropic", "claude-opus-4-6", "claude-sonnet-4-6", True),
    ("anthropic", "claude-sonnet-4-6", "claude-haiku-4-5", False),
    ("openai", "gpt-5", "gpt-5-mini", True),
    ("google", "gemini-2-5-pro", "gemini-2-5-flash", True),
]
# Intent, base score in hundredths, planner vendor and model, executor vendor and model, cheap model.
INTENTS = [
    ("extract", 90, "google", "gemini-2-5-flash", "openai", "gpt-5", "google:gemini-2-5-flash"),
    ("translate", 85, "google", "gemini-2-5-flash", "google", "gemini-2-5-pro", "google:gemini-2-5-flash"),
    ("summarize", 80, "openai", "gpt-5-mini", "anthropic", "claude-sonnet-4-6", "openai:gpt-5-mini"),
    ("code", 65, "anthropic", "claude-haiku-4-5", "anthropic", "claude-sonnet-4-6", "anthropic:claude-haiku-4-5"),
    ("analyze", 45, "anthropic", "claude-haiku-4-5", "anthropic", "claude-opus-4-6", "anthropic:claude-haiku-4-5"),
    ("creative", 30, "anthropic", "claude-haiku-4-5", "anthropic", "claude-opus-4-6", "anthropic:claude-haiku-4-5"),
    ("unknown", 50, "anthropic", "claude-haiku-4-5", "anthropic", "claude-sonnet-4-6", "anthropic:claude-haiku-4-5"),
]
# Test keys: kid, status, last moment at which a retired key counts.
KEYS = [("kid-0", "active", None), ("kid-1", "retired", "2024-01-15T00:00:00Z"), ("kid-2", "revoked", None), ("kid-3", "retired", None)]
# Test registries: use case, status, approved models, approved sources, approved classes; model, status, use cases.
USE_CASES = [
    ("uc-0", "active", ["gpt-5", "gpt-5-mini"], ["app-0", "app-1", "app-2"], ["internal", "public", "pii_redacted"]),
    ("uc-1", "active", ["claude-opus-4-6", "claude-haiku-4-5"], ["app-0", "app-3"], ["internal", "pii", "public"]),
    ("uc-2", "retired", ["gpt-5"], ["app-0"], ["internal"]),
    ("uc-3", "deprecated", ["gpt-4o"], ["app-1"], ["internal"]),
    ("uc-4", "active", ["gemini-2-5-pro", "gemini-2-5-flash", "gpt-4o"], ["app-0", "app-1", "app-2", "app-3", "app-4"], ["internal", "public", "pii", "pci", "mnpi", "pii_redacted"]),
    ("uc-5", "active", ["mistral-large"], ["app-4"], ["public"]),
    ("uc-6", "active", ["gpt-5-nano"], ["app-2"], ["internal", "public"]),
]
MODELS = [
    ("gpt-5", "approved", ["uc-0", "uc-2"]),
    ("gpt-5-mini", "approved_with_conditions", ["uc-0"]),
    ("gpt-5-nano", "validation", ["uc-6"]),
    ("gpt-4o", "retired", ["uc-3", "uc-4"]),
    ("claude-opus-4-6", "approved", ["uc-1"]),
    ("claude-haiku-4-5", "revoked", ["uc-1"]),
    ("gemini-2-5-pro", "approved", ["uc-4"]),
    ("gemini-2-5-flash", "development", ["uc-4", "uc-5"]),
]
# Framework, regulator label, article, severity (medium where the template has none), fields of which one satisfies it.
ARTICLES = [
    ("CBUAE", "CBUAE", "P1", "high", ["event.context.user_id", "use_case_id", "model_id", "decision.applied_policies"]),
    ("CBUAE", "CBUAE", "P2", "high", ["event.payload.metadata.fairness_metrics", "model_id"]),
    ("CBUAE", "CBUAE", "P3", "high", ["event.subject.ai_model", "event.subject.ai_vendor", "decision.reason_codes", "event.payload.input_hash", "event.payload.output_hash"]),
    ("CBUAE", "CBUAE", "P4", "critical", ["decision.decision", "decision.applied_policies", "provenance.parent_receipt_ids"]),
    ("CBUAE", "CBUAE", "P5", "critical", ["event.payload.input_classification", "event.payload.input_hash", "event.payload.metadata.safety"]),
    ("CBUAE", "CBUAE", "ART184", "critical", ["integrity.receipt_hash", "integrity.previous_receipt_hash", "integrity.chain_height", "timestamps"]),
    ("EU_AI_ACT", "EU_AI_ACT", "ART9", "critical", ["event.payload.metadata.safety", "use_case_id", "model_id"]),
    ("EU_AI_ACT", "EU_AI_ACT", "ART10", "high", ["event.payload.input_classification", "model_id"]),
    ("EU_AI_ACT", "EU_AI_ACT", "ART11_ANNEX_IV", "critical", ["integrity.receipt_hash", "event", "decision", "provenance"]),
    ("EU_AI_ACT", "EU_AI_ACT", "ART12", "critical", ["integrity.receipt_hash", "integrity.previous_receipt_hash", "integrity.chain_height", "timestamps"]),
    ("EU_AI_ACT", "EU_AI_ACT", "ART13", "high", ["event.subject.ai_vendor", "event.subject.ai_model", "decision.reason_codes"]),
    ("EU_AI_ACT", "EU_AI_ACT", "ART14", "high", ["decision.decision", "event.context.user_id", "provenance.parent_receipt_ids"]),
    ("EU_AI_ACT", "EU_AI_ACT", "ART15", "high", ["event.payload.metadata.safety", "event.payload.metadata.injection"]),
    ("EU_AI_ACT", "EU_AI_ACT", "ART50", "high", ["event.subject.ai_capability", "event.payload.output_hash"]),
    ("SAMA", "SAMA", "T1", "high", ["use_case_id", "model_id", "event.context.user_id"]),
    ("SAMA", "SAMA", "T2", "critical", ["event.context.region", "event.subject.ai_provider"]),
    ("SAMA", "SAMA", "T3", "high", ["integrity.receipt_hash", "integrity.previous_receipt_hash", "decision"]),
    ("SAMA", "SAMA", "T4", "high", ["event.context.service_id", "event.payload.metadata.safety"]),
    ("SAMA", "SAMA", "T5", "high", ["decision.decision", "decision.reason_codes"]),
    ("ISO_42001", "ISO_42001", "A.2.2", "medium", ["decision.policy_bundle_hash"]),
    ("ISO_42001", "ISO_42001", "A.4.3", "medium", ["use_case_id", "model_id"]),
    ("ISO_42001", "ISO_42001", "A.5.2", "medium", ["event.payload.metadata.safety", "event.payload.metadata.injection"]),
    ("ISO_42001", "ISO_42001", "A.6.2.6", "medium", ["model_id", "event.payload.metadata.validation_status"]),
    ("ISO_42001", "ISO_42001", "A.7.4", "medium", ["event.subject.ai_vendor", "event.subject.ai_provider", "model_id"]),
    ("ISO_42001", "ISO_42001", "A.10.2", "medium", ["event.subject.ai_vendor", "event.subject.ai_provider"]),
    ("ISO_27001", "ISO_42001", "A.5.10", "medium", ["decision.applied_policies", "event.context.user_id"]),
    ("ISO_27001", "ISO_42001", "A.5.34", "medium", ["event.payload.input_classification", "event.payload.metadata.safety"]),
    ("ISO_27001", "ISO_42001", "A.8.15", "medium", ["integrity.receipt_hash", "integrity.previous_receipt_hash", "event.captured_at"]),
    ("ISO_27001", "ISO_42001", "A.8.16", "medium", ["event.payload.metadata.safety", "event.payload.metadata.injection"]),
    ("ISO_27001", "ISO_42001", "A.8.25", "medium", ["model_id", "event.payload.metadata.validation_status"]),
    ("ISO_27001", "ISO_42001", "A.8.32", "medium", ["model_id", "event.subject.ai_model"]),
    ("NIST_AI_RMF", "NIST_RMF", "GOVERN-1.1", "medium", ["decision.applied_policies"]),
    ("NIST_AI_RMF", "NIST_RMF", "MAP-2.3", "medium", ["model_id", "event.payload.metadata.validation_status"]),
    ("NIST_AI_RMF", "NIST_RMF", "MEASURE-2.6", "medium", ["event.payload.metadata.latency_ms", "event.payload.output_token_count"]),
    ("NIST_AI_RMF", "NIST_RMF", "MEASURE-2.10", "medium", ["event.payload.input_classification", "event.payload.metadata.safety"]),
    ("NIST_AI_RMF", "NIST_RMF", "MANAGE-2.1", "medium", ["integrity.receipt_hash"]),
    ("HIPAA", "ISO_42001", "164.308.a.1.ii.D", "high", ["integrity.receipt_hash", "event.context.user_id", "event.payload.input_classification"]),
    ("HIPAA", "ISO_42001", "164.308.a.3", "high", ["event.context.user_id", "decision.applied_policies"]),
    ("HIPAA", "ISO_42001", "164.308.a.4", "high", ["event.context.user_id", "event.context.service_id", "decision.decision"]),
    ("HIPAA", "ISO_42001", "164.312.b", "critical", ["integrity.receipt_hash", "integrity.previous_receipt_hash", "integrity.chain_height", "timestamps"]),
    ("HIPAA", "ISO_42001", "164.312.c", "critical", ["integrity.receipt_hash", "event.payload.input_hash", "event.payload.output_hash"]),
    ("HIPAA", "ISO_42001", "164.312.e", "high", ["event.subject.ai_provider", "event.context.region"]),
    ("HIPAA", "ISO_42001", "164.404", "high", ["integrity.receipt_hash", "event.captured_at", "event.payload.metadata.safety"]),
    ("FEDRAMP", "NIST_RMF", "AC-2", "high", ["event.context.user_id", "event.context.service_id"]),
    ("FEDRAMP", "NIST_RMF", "AC-3", "high", ["decision.decision", "decision.applied_policies"]),
    ("FEDRAMP", "NIST_RMF", "AU-2", "critical", ["integrity.receipt_hash", "event.event_type", "event.captured_at"]),
    ("FEDRAMP", "NIST_RMF", "AU-9", "critical", ["integrity.receipt_hash", "integrity.previous_receipt_hash", "signatures"]),
    ("FEDRAMP", "NIST_RMF", "AU-10", "high", ["signatures", "integrity.receipt_hash"]),
    ("FEDRAMP", "NIST_RMF", "AU-12", "high", ["integrity.receipt_hash", "event"]),
    ("FEDRAMP", "NIST_RMF", "SI-12", "medium", ["event.payload.input_classification", "event.context.region"]),
    ("FEDRAMP", "NIST_RMF", "OMB-M-24-10", "high", ["use_case_id", "model_id", "event.subject.ai_capability"]),
    ("GDPR", "EU_AI_ACT", "ART5.1.a", "medium", ["event.payload.input_classification", "decision.applied_policies", "event.subject.ai_model"]),
    ("GDPR", "EU_AI_ACT", "ART5.2", "medium", ["integrity.receipt_hash", "integrity.previous_receipt_hash", "signatures"]),
    ("GDPR", "EU_AI_ACT", "ART22", "medium", ["decision.decision", "decision.reason_codes", "event.context.user_id"]),
    ("GDPR", "EU_AI_ACT", "ART30", "medium", ["integrity.receipt_hash", "event.event_type", "event.captured_at"]),
    ("GDPR", "EU_AI_ACT", "ART32", "medium", ["event.payload.input_hash", "event.payload.output_hash", "event.payload.metadata.safety"]),
    ("GDPR", "EU_AI_ACT", "ART33", "medium", ["integrity.receipt_hash", "event.captured_at", "event.payload.metadata.safety"]),
    ("GDPR", "EU_AI_ACT", "ART35", "medium", ["use_case_id", "model_id", "event.payload.metadata.safety"]),
]

TABLES = {
    "pricing": (PRICING, "vendor string, model string, nano_in bigint, nano_out bigint, nano_read bigint, nano_write bigint"),
    "energy": (ENERGY, "vendor string, model string, deci_wh_1k bigint, grid_g bigint"),
    "tiers": (TIERS, "vendor string, model string, cheaper string, premium boolean"),
    "intents": (INTENTS, "intent string, base_score bigint, planner_vendor string, planner_model string, executor_vendor string, executor_model string, cheap_model string"),
    "signing_keys": (KEYS, "kid string, status string, retired_at string"),
    "use_cases": (USE_CASES, "use_case_id string, status string, models array<string>, sources array<string>, classes array<string>"),
    "model_registry": (MODELS, "model string, status string, use_cases array<string>"),
    "articles": (ARTICLES, "framework string, regulator string, article_id string, severity string, fields array<string>"),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = TABLES[name]
    kind = spark.createDataFrame([], schema).schema
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], to_arrow_schema(kind)), kind)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, list):
        return "[" + ", ".join(_literal(y) for y in x) + "]"
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def cte(name: str) -> str:
    """The table as a common table expression for the SQL checks."""
    rows, schema = TABLES[name]
    columns = ", ".join(c.strip().split()[0] for c in schema.split(", "))
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(_literal(x) for x in r) + ")" for r in rows) + ")"
