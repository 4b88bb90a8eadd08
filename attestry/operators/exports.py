"""Export events in common log formats, and the check of incoming events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_export_events(rows: DataFrame) -> DataFrame:
    """Flat events of receipts: the outcome, where it says more than success, is the decision; else the decision."""
    decision = F.when(F.col("outcome") != "success", F.col("outcome")).otherwise(F.col("decision"))
    return rows.select(
        "receipt_id", "tenant_id", "captured_at", "event_type", F.col("app").alias("source_system"), F.col("event_id").cast("string").alias("event_id"), "chain_height", "receipt_hash", "previous_receipt_hash",
        "signed", F.when(F.col("signed"), F.col("kid")).alias("signature_kid"), F.col("vendor").alias("ai_vendor"), F.col("model").alias("ai_model"), decision.alias("decision"),
    )


def _flat(x: Column) -> Column:
    """One line: runs of control characters become a blank."""
    return F.trim(F.regexp_replace(x, r"[\x00-\x1F\x7F]+", " "))


def format_cef(events: DataFrame, vendor: str, product: str, version: str = "1.0") -> DataFrame:
    """receipt_id and a CEF line for each event; null fields are left out."""
    head = lambda x: F.regexp_replace(F.regexp_replace(_flat(x), r"\\", r"\\\\"), r"\|", r"\\|")
    value = lambda x: F.regexp_replace(F.regexp_replace(_flat(x.cast("string")), r"\\", r"\\\\"), "=", r"\\=")
    severity = F.when(F.col("decision") == "block", "8").when(F.col("decision") == "require-approval", "6").when(F.col("decision") == "flag", "5").otherwise("3")
    header = F.concat_ws("|", F.lit("CEF:0"), head(F.lit(vendor)), head(F.lit(product)), head(F.lit(version)), head(F.col("event_type")), F.lit("AI decision receipt"), severity)
    millis = F.unix_millis(F.try_to_timestamp("captured_at"))
    pairs = [
        ("rt", F.when(millis != 0, millis)), ("externalId", F.col("receipt_id")), ("deviceCustomString1", F.col("tenant_id")), ("deviceCustomString1Label", F.lit("tenantId")),
        ("deviceCustomString2", F.col("receipt_hash")), ("deviceCustomString2Label", F.lit("receiptHash")), ("deviceCustomString3", F.col("ai_model")), ("deviceCustomString3Label", F.lit("aiModel")),
        ("deviceCustomNumber1", F.col("chain_height")), ("deviceCustomNumber1Label", F.lit("chainHeight")), ("outcome", F.col("decision")), ("dvchost", F.col("source_system")), ("cs4Label", F.lit("assuranceLevel")),
    ]
    told = F.concat_ws(" ", *[F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(k + "="), value(v))) for k, v in pairs])
    return events.select("receipt_id", F.concat(header, F.lit("|"), told).alias("line"))


def format_syslog(events: DataFrame, host: str, app: str, facility: int = 10) -> DataFrame:
    """receipt_id and an RFC 5424 line for each event; a timestamp that can't be read is the epoch."""
    pri = facility * 8 + F.when(F.col("decision") == "block", 4).otherwise(6)
    ts = F.date_format(F.coalesce(F.try_to_timestamp("captured_at"), F.timestamp_millis(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    escaped = lambda x: F.regexp_replace(_flat(x.cast("string")), r'([\]"\\])', r"\\$1")
    pairs = [("receiptId", "receipt_id"), ("tenantId", "tenant_id"), ("receiptHash", "receipt_hash"), ("chainHeight", "chain_height"), ("eventType", "event_type"), ("decision", "decision")]
    data = F.concat_ws(" ", *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f'{k}="'), escaped(F.col(c)), F.lit('"'))) for k, c in pairs])
    ident = F.regexp_replace(_flat(F.col("event_id")), r"\s", "_")
    message = _flat(F.concat(F.lit("AI receipt "), F.col("event_type"), F.lit(" tenant="), F.col("tenant_id"), F.lit(" decision="), F.coalesce("decision", F.lit("n/a"))))
    line = F.concat(F.lit("<"), pri.cast("string"), F.lit(">1 "), ts, F.lit(f" {host} {app} - "), F.when(ident == "", "-").otherwise(ident), F.lit(" [receipt@0 "), data, F.lit("] "), message)
    return events.select("receipt_id", line.alias("line"))


def validate_events(events: DataFrame) -> DataFrame:
    """events with error: the first field that is wrong, null for a valid event."""
    bad = lambda c, pattern: ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    known = lambda c, values: F.col(c).isNotNull() & ~F.col(c).isin(*values)
    classes = ("public", "internal", "pii", "pii_redacted", "pci", "mnpi")
    error = (
        F.when(~F.col("schema_version").eqNullSafe("1.0"), "event.schema_version")
        .when(bad("tenant_id", r"^[A-Za-z0-9._:-]{1,128}$"), "event.tenant_id")
        .when(bad("event_type", r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+$"), "event.event_type")
        .when(F.coalesce("source_system", F.lit("")) == "", "event.source_system")
        .when(bad("event_id", r"^[A-Za-z0-9._:-]{1,256}$"), "event.event_id")
        .when(bad("captured_at", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), "event.captured_at")
        .when(known("environment", ("production", "staging", "development")), "event.context.environment")
        .when(known("input_class", classes), "event.payload.input_classification")
        .when(known("output_class", classes), "event.payload.output_classification")
    )
    return events.withColumn("error", error)


def conversations_to_events(turns: DataFrame) -> DataFrame:
    """One event for each pair of a prompt and its answer (conv_id, turn, input_text, output_text): hashes and sizes, no texts."""
    return turns.select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id"), F.col("turn")).alias("event_id"), F.lit("chat.completion").alias("event_type"), F.sha2(F.coalesce("input_text", F.lit("")), 256).alias("input_hash"),
        F.sha2(F.coalesce("output_text", F.lit("")), 256).alias("output_hash"), F.ceil(F.length("input_text") / 4).alias("input_tokens"), F.ceil(F.length("output_text") / 4).alias("output_tokens"),
    )


def assurance_level(rows: DataFrame, attested: list[str]) -> DataFrame:
    """receipt_id, level: L0 unverified, L1 signed and chained, L2 by an attested key, L3 anchored too (rows: signed, link_ok, kid, anchored)."""
    one = F.col("signed") & F.col("link_ok")
    two = one & F.col("kid").isin(*attested)
    return rows.select("receipt_id", F.when(two & F.col("anchored"), "L3").when(two, "L2").when(one, "L1").otherwise("L0").alias("level"))


def check_rules(rules: DataFrame, values: DataFrame) -> DataFrame:
    """id, checked, failed, verified: rules (id, rule: `field OP number`) against values (id, vals: map of field to double).

    A rule that can't be read, or a field without a value, fails; verified needs a rule at least and none failed.
    """
    pattern = r"^\s*([A-Za-z_][A-Za-z0-9_.]*)\s*(<=|>=|==|!=|<|>)\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
    part = lambda k: F.regexp_extract("rule", pattern, k)
    joined = rules.join(values, "id", "left").withColumn("_v", F.try_element_at("vals", part(1))).withColumn("_o", part(2)).withColumn("_n", F.when(part(3) != "", part(3)).cast("double"))
    v, n = F.col("_v"), F.col("_n")
    held = F.when(F.col("_o") == "<=", v <= n).when(F.col("_o") == ">=", v >= n).when(F.col("_o") == "==", v == n).when(F.col("_o") == "!=", v != n).when(F.col("_o") == "<", v < n).when(F.col("_o") == ">", v > n)
    failed = ~F.coalesce(held, F.lit(False))
    return joined.groupBy("id").agg(F.count("rule").alias("checked"), F.count_if(failed & F.col("rule").isNotNull()).alias("failed")).withColumn("verified", (F.col("checked") > 0) & (F.col("failed") == 0))
