"""Who may do what, and what regulators ask for: key validity, registries, citations, reviews, approvals, alerts, views.

Dimensions (keys, registries, articles) are looked up: broadcast below a counted size, else joined with hot keys split. Evidence samples are cut by row_number before they are collected,
so no group is gathered whole. Order ties are broken by receipt_id everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.columns import half_up, share, usd
from attestry.functions.tables import lookup, written


def keys_valid_at(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (kid, captured_at) with key_ok: an active key, or a retired one up to its retirement moment; else closed."""
    status = keys.select("kid", F.col("status").alias("_status"), F.try_to_timestamp("retired_at").alias("_until"))
    joined = lookup(rows, status, ["kid"])
    ok = (F.col("_status") == "active") | ((F.col("_status") == "retired") & (F.try_to_timestamp("captured_at") <= F.col("_until")))
    return joined.withColumn("key_ok", F.coalesce(ok, F.lit(False))).drop("_status", "_until")


#: Seconds of a cell of time in which `keys_as_of` orders a key's receipts.
CELL_SECONDS = 86_400


def keys_as_of(rows: DataFrame, windows: DataFrame, at: str = "captured_at") -> DataFrame:
    """rows with key_status and key_ok: the kid's window (kid, valid_from, valid_until, status) that began last before or at a row's time.

    A key may have any number of windows: rotations, retirements, revocations. The row's key is good if that window is
    active, or retired, and has not ended (valid_until null: open; the end itself counts). Rows without a kid, a time or a
    window, and windows without a start, are closed. Of windows with one start the one with the lesser end (open last) comes last.

    An as-of pass, not a range join: rows and window starts are put in order inside cells of a kid's time, so that a hot
    kid isn't sorted in one task; what held when a cell began comes from the windows and the kid's cells alone.
    """
    order = [F.col("_t"), F.col("_kind"), F.col("_end").desc_nulls_first()]
    second = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c).cast("string")))
    cell = F.floor(F.col("_t") / (CELL_SECONDS * 1_000_000)).alias("_cell")
    starts = windows.select("kid", second("valid_from").alias("_t"), second("valid_until").alias("_end"), F.col("status").alias("_status")).where("kid is not null and _t is not null")
    starts = starts.withColumn("_w", F.struct(F.col("_end").alias("until"), F.col("_status").alias("status"))).withColumn("_kind", F.lit(0))
    held = rows.withColumn("_t", second(at)).withColumn("_kind", F.lit(1)).withColumn("_end", F.lit(None).cast("long"))
    cells = held.where("kid is not null and _t is not null").select("kid", cell).distinct()
    # the last window before each cell: cells take part as rows that begin at their own start, before any window there
    edges = cells.select("kid", "_cell", (F.col("_cell") * (CELL_SECONDS * 1_000_000)).alias("_t"), F.lit(-1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.lit(None).cast(starts.schema["_w"].dataType).alias("_w"))
    both = edges.unionByName(starts.select("kid", F.lit(None).cast("long").alias("_cell"), "_t", "_kind", "_end", "_w"))
    before = both.withColumn("_before", F.last("_w", ignorenulls=True).over(Window.partitionBy("kid").orderBy(*order))).where("_kind = -1").select("kid", "_cell", "_before")
    slim = held.withColumn("_row", F.struct(*rows.columns)).select("kid", "_t", cell, "_kind", "_end", "_row")
    mixed = slim.unionByName(starts.select("kid", "_t", cell, "_kind", "_end", "_w"), allowMissingColumns=True)
    inside = F.last("_w", ignorenulls=True).over(Window.partitionBy("kid", "_cell").orderBy(*order))
    known = mixed.withColumn("_in", inside).where("_kind = 1").join(before, ["kid", "_cell"], "left")
    w = F.coalesce("_in", "_before")
    ok = w["status"].isin("active", "retired") & F.coalesce(F.col("_t") <= w["until"], F.lit(True))
    status = F.when(F.col("_t").isNotNull(), w["status"])
    return known.select("_row", status.alias("key_status"), (F.coalesce(ok, F.lit(False)) & F.col("_t").isNotNull()).alias("key_ok")).select("_row.*", "key_status", "key_ok")


#: Where a flat receipt holds each field path of the articles.
PATHS = {
    "event.context.user_id": "user_name is not null",
    "use_case_id": "use_case_id is not null",
    "model_id": "model is not null",
    "event.subject.ai_model": "model is not null",
    "event.subject.ai_vendor": "vendor is not null",
    "decision": "decision is not null",
    "decision.decision": "decision is not null",
    "decision.applied_policies": "applied_policies is not null",
    "event.payload.input_classification": "input_class is not null",
    "event.payload.output_token_count": "output_tokens is not null",
    "event": "event_id is not null",
    "event.event_type": "event_type is not null",
    "event.captured_at": "captured_at is not null",
    "provenance": "workflow_id is not null",
    "provenance.parent_receipt_ids": "parent_id is not null",
    "integrity.receipt_hash": "receipt_hash is not null",
    "integrity.previous_receipt_hash": "previous_receipt_hash is not null",
    "integrity.chain_height": "chain_height is not null",
    "signatures": "signed",
}


def present_paths(rows: DataFrame) -> DataFrame:
    """rows with present: the field paths that the receipt holds."""
    return rows.withColumn("present", F.filter(F.array(*[F.when(F.expr(e), F.lit(p)) for p, e in PATHS.items()]), lambda x: x.isNotNull()))


def cite_receipts(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """receipt_id, framework, regulator, article_id, confidence (present / required, 2 digits) where a required field is there.

    Receipts that hold the same fields have the same citations: those are found once for each set of fields that occurs
    (at most two to the number of PATHS), and only then told to the receipts.
    """
    bits = sum((F.when(F.expr(e), 1 << k).otherwise(0) for k, e in enumerate(PATHS.values())), F.lit(0))
    told = rows.select("receipt_id", bits.alias("_fields"))
    present = F.filter(F.array(*[F.when(F.col("_fields").bitwiseAND(F.lit(1 << k)) != 0, F.lit(p)) for k, p in enumerate(PATHS)]), lambda x: x.isNotNull())
    packed = articles.agg(F.collect_list(F.struct("framework", "regulator", "article_id", "fields")).alias("a"))  # one row
    met = told.select("_fields").distinct().withColumn("present", present).join(packed).select("_fields", "present", F.explode("a").alias("a")).select("_fields", "present", "a.*")
    n = F.size(F.array_intersect("fields", "present"))
    cited = met.withColumn("n", n).where("n > 0").withColumn("confidence", half_up(F.col("n") / F.size("fields"), 2))
    packed = written(cited.groupBy("_fields").agg(F.collect_list(F.struct("framework", "regulator", "article_id", "confidence")).alias("_cited")))
    return lookup(told, packed, ["_fields"], "inner").select("receipt_id", F.explode("_cited").alias("c")).select("receipt_id", "c.*")


def regulator_coverage(citations: DataFrame, articles: DataFrame) -> DataFrame:
    """framework, citations, confidence in whole hundredths on average (4 digits), articles satisfied and in all."""
    total = articles.groupBy("framework").agg(F.count(F.lit(1)).alias("articles_total"))
    found = citations.groupBy("framework").agg(F.count(F.lit(1)).alias("citations"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("points"), F.countDistinct("article_id").alias("articles_satisfied"))
    joined = total.join(found, "framework", "left")
    n = F.coalesce("citations", F.lit(0))
    return joined.select("framework", n.alias("citations"), share(F.coalesce("points", F.lit(0)) / 100.0, n).alias("confidence"), F.coalesce("articles_satisfied", F.lit(0)).alias("articles_satisfied"), "articles_total")


def compliance_gaps(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """framework, article_id, field, severity, missing: how many receipts lack each required field."""
    counts = present_paths(rows).select(F.explode("present").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    fields = articles.select("framework", "article_id", "severity", F.explode("fields").alias("field"))
    joined = fields.join(counts, "field", "left").join(total)
    return joined.select("framework", "article_id", "field", "severity", (F.col("total") - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")


def validate_use_case(rows: DataFrame, use_cases: DataFrame) -> DataFrame:
    """receipt_id, ok, reasons: unknown or ended use cases stop there; else model, source and class are checked."""
    registry = use_cases.select("use_case_id", F.col("status").alias("_status"), "models", "sources", "classes")
    joined = lookup(rows, registry, ["use_case_id"])
    none = F.array().cast("array<string>")
    checks = F.array(
        F.when(F.col("model").isNotNull() & ~F.array_contains("models", F.col("model")), "model_not_approved_for_use_case"),
        F.when((F.size("sources") > 0) & ~F.array_contains("sources", F.col("app")), "source_not_approved_for_use_case"),
        F.when(~F.array_contains("classes", F.col("input_class")), "data_classification_above_approved_tier"),
    )
    reasons = (
        F.when(F.col("_status").isNull(), F.array(F.concat(F.lit("unknown_use_case:"), "use_case_id")))
        .when(F.col("_status").isin("retired", "deprecated"), F.array(F.concat(F.lit("use_case_lifecycle:"), "_status")))
        .otherwise(F.coalesce(F.filter(checks, lambda x: x.isNotNull()), none))
    )
    return joined.select("receipt_id", reasons.alias("r")).select("receipt_id", (F.size("r") == 0).alias("ok"), F.concat_ws(",", "r").alias("reasons"))


def validate_model_assignment(rows: DataFrame, models: DataFrame) -> DataFrame:
    """receipt_id, reason: the first thing against the receipt's model in its use case; null if there is none."""
    registry = models.select("model", F.col("status").alias("_status"), "use_cases")
    joined = lookup(rows.where("model is not null"), registry, ["model"])
    reason = (
        F.when(F.col("_status").isNull(), "unknown_model")
        .when(F.col("_status") == "revoked", "model_revoked")
        .when(F.col("_status") == "retired", "model_retired")
        .when(F.col("_status").isin("development", "validation"), F.concat(F.lit("model_not_production_ready:"), "_status"))
        .when(~F.array_contains("use_cases", F.col("use_case_id")), "model_not_approved_for_use_case")
    )
    return joined.select("receipt_id", reason.alias("reason"))


def unlogged_receipts(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Receipts without an entry in the log (receipt_id)."""
    return rows.join(log.select("receipt_id"), "receipt_id", "left_anti").select("receipt_id", "tenant_id")


def missing_policy_bundles(rows: DataFrame, bundles: DataFrame) -> DataFrame:
    """Receipts whose bundle_hash isn't among the bundles (bundle_hash); null hashes are missing."""
    return rows.join(bundles.select("bundle_hash"), "bundle_hash", "left_anti").select("receipt_id", "bundle_hash")


def dedup_captures(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows with an equal key, the first by captured time, then by receipt_id."""
    first = Window.partitionBy(*key).orderBy("captured_at", "receipt_id")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def actions_cleared(actions: DataFrame, verdicts: DataFrame, now: str, allow_concerns: bool = False) -> DataFrame:
    """Each verdict on a known action: valid unless it has expired or the reviewer is the actor; cleared by approval."""
    joined = verdicts.join(actions.select("tenant_id", "action_hash", "actor"), ["tenant_id", "action_hash"])
    expired = F.coalesce(F.try_to_timestamp("expires_at") <= F.try_to_timestamp(F.lit(now)), F.lit(True))
    valid = ~expired & (F.col("reviewer") != F.col("actor"))
    good = F.col("verdict").isin("approve", "concerns") if allow_concerns else F.col("verdict") == "approve"
    return joined.select("tenant_id", "action_hash", "line", "kid", "reviewer", "verdict", valid.alias("valid"), (valid & good).alias("cleared"))


def review_n_of_m(checked: DataFrame, threshold: int = 2) -> DataFrame:
    """Per action, of valid verdicts: distinct approving keys, rejections, keys under several names, cleared."""
    good = F.col("verdict") == "approve"
    valid = checked.where("valid")
    keys = valid.groupBy("tenant_id", "action_hash", "kid").agg(F.count_if(good).alias("yes"), F.count_if(F.col("verdict") == "reject").alias("no"), F.countDistinct(F.when(good, F.col("reviewer"))).alias("names"))
    summed = keys.groupBy("tenant_id", "action_hash").agg(F.count_if(F.col("yes") > 0).alias("approvals"), F.sum("no").alias("rejects"), F.count_if(F.col("names") > 1).alias("shared_keys"))
    return summed.withColumn("cleared", (F.col("rejects") == 0) & (F.col("approvals") >= threshold))


def approval_status(requests: DataFrame, decisions: DataFrame, threshold: int = 2) -> DataFrame:
    """request, status, decided_ts. requests: request, deadline_ts. decisions: request, approver, decision, ts, seq.

    In time order, an approver's first decision before the deadline counts; the first rejection rejects, the
    threshold-th approval before it approves; without either the request is expired at its deadline. Of decisions
    of one ts and seq a rejection comes first, so the answer doesn't depend on the order of the rows and a tie never approves.
    """
    place = ("ts", "seq", F.col("decision") != "reject", "decision")
    once = Window.partitionBy("request", "approver").orderBy(*place)
    known = decisions.join(requests, "request").where("ts < deadline_ts").withColumn("_r", F.row_number().over(once)).where("_r = 1")
    order = Window.partitionBy("request").orderBy(*place)
    ran = known.withColumn("at", F.row_number().over(order)).withColumn("yes", F.sum(F.when(F.col("decision") == "approve", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ran.groupBy("request").agg(
        F.min(F.when(F.col("decision") == "reject", F.struct("at", "ts"))).alias("no"), F.min(F.when((F.col("decision") == "approve") & (F.col("yes") >= threshold), F.struct("at", "ts"))).alias("yes")
    )
    joined = requests.join(ends, "request", "left")
    approved = F.col("yes").isNotNull() & (F.col("no").isNull() | (F.col("yes.at") < F.col("no.at")))
    status = F.when(approved, "approved").when(F.col("no").isNotNull(), "rejected").otherwise("expired")
    return joined.select("request", status.alias("status"), F.when(approved, F.col("yes.ts")).when(F.col("no").isNotNull(), F.col("no.ts")).otherwise(F.col("deadline_ts")).alias("decided_ts"))


def invalid_transitions(log: DataFrame, permitted: DataFrame) -> DataFrame:
    """Rows of log (subject, seq, from_state, to_state) that aren't permitted, or don't start where the one before ended.

    Rows of one seq are taken by their states, so the answer doesn't depend on the order of the rows.
    """
    last = F.lag("to_state").over(Window.partitionBy("subject").orderBy("seq", "from_state", "to_state"))
    rules = permitted.select("from_state", "to_state", F.lit(True).alias("_known"))
    joined = lookup(log.withColumn("_last", last), rules, ["from_state", "to_state"])
    why = F.when(F.col("_known").isNull(), "not_permitted").when(F.col("_last").isNotNull() & (F.col("_last") != F.col("from_state")), "broken_sequence")
    return joined.select("subject", "seq", "from_state", "to_state", why.alias("why")).where("why is not null")


def sampled(rows: DataFrame, key: str, n: int, order: tuple[str, ...] = ("receipt_id",)) -> DataFrame:
    """key and sample: the first n receipt ids of each key, joined by commas."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n)
    return first.groupBy(key).agg(F.concat_ws(",", F.sort_array(F.collect_list("receipt_id"))).alias("sample"))


def model_inventory(rows: DataFrame) -> DataFrame:
    """Per model: invocations, tenants, block, flag and error rates, use cases in order, the first five receipts."""
    asked = rows.where("model is not null")
    n = F.count(F.lit(1))
    summed = asked.groupBy("model").agg(
        n.alias("invocations"),
        F.countDistinct("tenant_id").alias("distinct_tenants"),
        share(F.count_if(F.col("decision") == "block"), n).alias("block_rate"),
        share(F.count_if(F.col("decision") == "flag"), n).alias("flag_rate"),
        share(F.count_if(F.col("outcome") == "error"), n).alias("error_rate"),
        F.concat_ws(",", F.sort_array(F.collect_set("use_case_id"))).alias("use_cases"),
    )
    return summed.join(sampled(asked, "model", 5), "model")


def use_case_inventory(rows: DataFrame) -> DataFrame:
    return rows.groupBy("use_case_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("model"))).alias("models"), F.count(F.lit(1)).alias("invocations"))


def monitoring_summary(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("invocations"),
        F.count_if(F.col("decision") == "block").alias("blocks"),
        F.count_if(F.col("decision") == "flag").alias("flags"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        share(F.count_if(F.size("applied_policies") > 0), n).alias("coverage"),
    )


def validation_activities(rows: DataFrame) -> DataFrame:
    """activity, receipts, sample: reviewed (10 ids), guardrail-blocked (10), uncited receipts (5)."""
    kinds = [("human_review", "reviewer <> 'pending'", 10), ("guardrail_sampling", "outcome = 'guardrail_block'", 10), ("citation_completeness", "size(applied_policies) = 0", 5)]
    out = None
    for name, met, n in kinds:
        own = rows.where(met).withColumn("activity", F.lit(name))
        one = own.groupBy("activity").agg(F.count(F.lit(1)).alias("receipts")).join(sampled(own, "activity", n), "activity")
        out = one if out is None else out.unionByName(one)
    return out


def model_findings(rows: DataFrame) -> DataFrame:
    """model, severity, rate, evidence: error rate above 5 % is high, flag rate above 10 % medium; up to ten receipts."""
    inventory = model_inventory(rows)
    out = None
    for severity, rate, least, met in (("high", "error_rate", 0.05, "outcome = 'error'"), ("medium", "flag_rate", 0.10, "decision = 'flag'")):
        evidence = sampled(rows.where(met).where("model is not null"), "model", 10).withColumnRenamed("sample", "evidence")
        one = inventory.where(F.col(rate) > least).select("model", F.lit(severity).alias("severity"), F.col(rate).alias("rate")).join(evidence, "model", "left")
        out = one if out is None else out.unionByName(one)
    return out


#: Rule, severity and predicate over flat receipts.
ALERT_RULES = [
    ("blocked-decisions", "high", "decision = 'block'"),
    ("sensitive-data", "high", "input_class in ('pii', 'pci', 'mnpi') or output_class in ('pii', 'pci', 'mnpi')"),
    ("unsigned-receipts", "high", "not signed"),
    ("high-stakes-no-evidence", "medium", "decision in ('block', 'require-approval') and evidence_refs = 0"),
    ("flagged-and-pending", "medium", "decision in ('flag', 'require-approval')"),
]


def alert_rules_per_receipt(rows: DataFrame, rules: list[tuple[str, str, str | Column]] = ALERT_RULES) -> DataFrame:
    """rule, severity, receipt_id for every rule that a receipt meets, in one pass."""
    met = F.array(*[F.when(F.expr(p) if isinstance(p, str) else p, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p in rules])
    return rows.select("receipt_id", F.explode(F.filter(met, lambda x: x.isNotNull())).alias("a")).select("a.rule", "a.severity", "receipt_id")


def alert_over_tiering(rows: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Receipts of the (model, app) pairs of over_tiering."""
    return lookup(rows, written(suggestions.select("model", "app").distinct()), ["model", "app"], "left_semi").select(F.lit("over-tiering").alias("rule"), F.lit("medium").alias("severity"), "receipt_id")


def run_alerts(rows: DataFrame, more: list[Callable[[DataFrame], DataFrame]] = (), cap: int = 20) -> DataFrame:
    """rule, severity, receipts, sample (at most `cap` ids) of all rules. more: functions that return (rule, severity, receipt_id).

    What a function finds is written by itself first, so that one which can't be planned, or breaks while it runs, is left
    out as a whole and never stops the run.
    """
    found = alert_rules_per_receipt(rows)
    for rule in more:
        try:
            found = found.unionByName(written(rule(rows).select("rule", "severity", "receipt_id")))
        except Exception:  # noqa: BLE001
            continue
    counts = found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("receipts"))
    return counts.join(sampled(found, "rule", cap), "rule").orderBy(F.col("severity") != "high", F.desc("receipts"), "rule")


#: The parts of the exposure and their weights.
RISKS = {"error": 0.20, "block": 0.10, "findings": 0.15, "incidents": 0.15, "posture": 0.15, "downtime": 0.10, "uncovered": 0.15}


def underwriting_exposure(rows: DataFrame, findings: DataFrame, regulators: DataFrame) -> DataFrame:
    """Per tenant and period: rates, the seven risk components, weighted, and their sum with its class.

    rows have `period`. findings: tenant_id, period, high_findings, incidents. regulators: tenant_id, period, covered.
    Controls pass where receipts are signed. A component is its value times its weight times 100, with four digits; the
    composite is clamped to 0 to 100.
    """
    key, n = ["tenant_id", "period"], F.count(F.lit(1))
    base = rows.groupBy(*key).agg(
        n.alias("receipts"),
        share(F.count_if(F.col("outcome") == "error"), n).alias("error_rate"),
        share(F.count_if(F.col("decision") == "block"), n).alias("block_rate"),
        share(F.count_if("signed"), n).alias("posture"),
        half_up(1 - F.count_if(F.col("outcome") == "error") / n, 4).alias("uptime"),
        F.countDistinct("model").alias("models"),
    )
    joined = base.join(findings, key, "left").join(regulators, key, "left").na.fill(0)
    values = {
        "error": F.col("error_rate"),
        "block": F.col("block_rate"),
        "findings": F.col("high_findings") / F.greatest(F.lit(1), F.col("models")),
        "incidents": F.col("incidents").cast("double"),
        "posture": 1 - F.col("posture"),
        "downtime": 1 - F.col("uptime"),
        "uncovered": 1 - F.col("covered") / 6,
    }
    out = joined.select(*key, "receipts", "error_rate", "block_rate", F.col("posture").alias("controls_posture"), *[half_up(values[k] * w * 100, 4).alias(f"risk_{k}") for k, w in RISKS.items()])
    total = F.lit(0.0)
    for k in RISKS:
        total = total + F.col(f"risk_{k}")
    composite = F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_up(total, 4)))
    c = F.col("composite")
    return out.withColumn("composite", composite).withColumn("carrier_class", F.when(c <= 20, "A").when(c <= 35, "B").when(c <= 55, "C").when(c <= 75, "D").otherwise("E"))


#: The frameworks whose citations a score counts.
SCORED = ("CBUAE", "EU_AI_ACT", "SAMA", "ISO_42001", "NIST_AI_RMF")


def score_counters(rows: DataFrame, checks: DataFrame, log: DataFrame, verdicts: DataFrame | None = None, citations: DataFrame | None = None) -> DataFrame:
    """The eight counters of receipt_score per tenant.

    rows: receipts with signed, outcome, decision, applied_policies. checks: receipt_id, valid (verify_envelopes). log:
    receipt_id of the entries of the transparency log. verdicts: receipt_id, verdict (safety_verdict): findings are the
    receipts with another verdict than allow; without it, those whose outcome isn't success. citations: receipt_id, framework
    (cite_receipts): regulators are the frameworks of SCORED that a tenant's receipts cite; without it, applied policies.
    """
    joined = rows.join(checks.select("receipt_id", "valid"), "receipt_id", "left").join(log.select("receipt_id", F.lit(True).alias("_logged")).distinct(), "receipt_id", "left")
    signed, bad = F.col("signed"), F.col("outcome") != "success"
    if verdicts is not None:
        joined = joined.join(verdicts.select("receipt_id", F.col("verdict").alias("_verdict")), "receipt_id", "left")
        bad = F.coalesce(F.col("_verdict") != "allow", F.lit(False))
    counted = joined.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("invocations"), F.count_if(signed).alias("with_receipt"), F.count_if(signed & F.col("valid")).alias("verified"), F.count_if(signed).alias("checked"),
        F.count_if(bad).alias("findings"), F.count_if(bad & F.col("decision").isNotNull()).alias("handled"), F.count_if(signed & F.col("_logged")).alias("logged"),
    )
    if citations is None:
        cited = rows.select("tenant_id", F.explode("applied_policies").alias("p"))
    else:
        own = citations.where(F.col("framework").isin(*SCORED)).groupBy("receipt_id").agg(F.collect_set("framework").alias("f"))
        cited = rows.select("tenant_id", "receipt_id").join(own, "receipt_id").select("tenant_id", F.explode("f").alias("p"))
    covered = cited.groupBy("tenant_id").agg(F.countDistinct("p").alias("regulators"))
    return counted.join(covered, "tenant_id", "left").na.fill(0)


def receipt_score(counters: DataFrame) -> DataFrame:
    """tenant_id, five sub-scores of 0 to 100 (1 digit), the weighted score and its grade, from eight counters a tenant."""
    part = lambda a, b, empty: F.when(F.col(b) == 0, F.lit(empty)).otherwise(half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.col(a) / F.col(b))), 1))
    subs = counters.select(
        "tenant_id",
        part("with_receipt", "invocations", 0.0).alias("coverage"),
        part("verified", "checked", 0.0).alias("verification"),
        part("handled", "findings", 100.0).alias("safety"),
        half_up(F.least(F.lit(100.0), 100.0 * F.col("regulators") / 5), 1).alias("regulatory"),
        part("logged", "with_receipt", 0.0).alias("transparency"),
    )
    score = half_up(F.col("coverage") * 0.25 + F.col("verification") * 0.25 + F.col("safety") * 0.2 + F.col("regulatory") * 0.15 + F.col("transparency") * 0.15, 1)
    out = subs.withColumn("score", score)
    grade = F.when(F.col("score") >= 95, "A+").when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B").when(F.col("score") >= 55, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return out.withColumn("grade", grade)


def vendor_benchmark(rows: DataFrame, pricing: DataFrame) -> DataFrame:
    """Per vendor and model: rates, dollars an outcome and the composite; both null without a price."""
    n = F.count(F.lit(1))
    samples = rows.where("model is not null").groupBy("vendor", "model").agg(
        n.alias("invocations"),
        F.count_if(F.col("decision") == "block").alias("blocked"),
        F.count_if(F.col("decision") == "flag").alias("flagged"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("reviewer").isNotNull() & (F.col("reviewer") != "pending")).alias("reviewed"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if((F.col("outcome") == "error") & (F.col("decision") == "block")).alias("severe"),
    )
    joined = lookup(samples, pricing, ["vendor", "model"])
    fine = F.greatest(F.lit(1), F.col("invocations") - F.col("errors") - F.col("blocked"))
    nano = F.col("input_tokens") * F.col("nano_in") + F.col("output_tokens") * F.col("nano_out")
    out = joined.select(
        "vendor",
        "model",
        "invocations",
        share(F.col("flagged") + F.col("errors"), F.col("invocations")).alias("hallucination_proxy"),
        half_up(usd(nano) / fine, 4).alias("cost_per_outcome_usd"),
        share(F.col("reviewed"), F.col("invocations")).alias("compliance_posture"),
        half_up(F.least(F.lit(1.0), F.col("severe") / 10), 4).alias("supply_chain_risk"),
    )
    score = F.col("hallucination_proxy") * 40 + F.least(F.lit(1.0), F.col("cost_per_outcome_usd") * 1000) * 20 + (1 - F.col("compliance_posture")) * 20 + F.col("supply_chain_risk") * 20
    return out.withColumn("composite", F.when(F.col("cost_per_outcome_usd").isNotNull(), half_up(score, 4)))


def rank_vendors(scores: DataFrame) -> DataFrame:
    """ranking, place, vendor, model: four rankings; models without a price are in neither the cost list nor its order but in cost_unknown."""
    lists = [
        ("hallucination", F.col("hallucination_proxy"), F.lit(True)),
        ("cost_per_outcome", F.col("cost_per_outcome_usd"), F.col("cost_per_outcome_usd").isNotNull()),
        ("compliance_posture", -F.col("compliance_posture"), F.lit(True)),
        ("supply_chain", F.col("supply_chain_risk"), F.lit(True)),
        ("cost_unknown", F.lit(0.0), F.col("cost_per_outcome_usd").isNull()),
    ]
    each = F.explode(F.filter(F.array(*[F.when(met, F.struct(F.lit(n).alias("ranking"), v.cast("double").alias("value"))) for n, v, met in lists]), lambda x: x.isNotNull()))
    long = scores.select("vendor", "model", each.alias("r")).select("vendor", "model", "r.*")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("ranking").orderBy("value", "vendor", "model"))).drop("value")


def hr_violators(rows: DataFrame, now: str) -> DataFrame:
    """Blocked receipts per user and team in the seven days before `now`, with a severity and the last one."""
    recent = rows.where((F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr("interval 7 days")) & (F.col("decision") == "block"))
    out = recent.groupBy("user_name", F.coalesce("team", F.lit("Unknown")).alias("team")).agg(F.count(F.lit(1)).alias("events"), F.max(F.substring("captured_at", 1, 16)).alias("last_event"))
    return out.withColumn("severity", F.when(F.col("events") >= 4, "high").when(F.col("events") >= 2, "medium").otherwise("low"))


def hr_teams(rows: DataFrame, now: str) -> DataFrame:
    recent = rows.where(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr("interval 7 days"))
    return recent.groupBy(F.coalesce("team", F.lit("Unknown")).alias("team")).agg(F.countDistinct("user_name").alias("users"), F.count_if(F.col("decision") == "block").alias("violations_week"))


def gdpr22_events(rows: DataFrame) -> DataFrame:
    met = rows.where(F.array_contains("applied_policies", "GDPR_ARTICLE_22"))
    return met.select("receipt_id", F.substring("captured_at", 12, 5).alias("time"), F.col("user_name").alias("subject"), F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("reviewer", F.lit("pending")).alias("reviewed_by"), F.coalesce("decision", F.lit("pending")).alias("status"))


def spend_by_team(rows: DataFrame) -> DataFrame:
    """team, month, spend, tokens in millions, growth over the month before, use case with most spend (ties by name)."""
    month = F.substring("captured_at", 1, 7)
    cost = F.coalesce("nano", F.lit(0))
    by_case = rows.groupBy(F.coalesce("team", F.lit("Unknown")).alias("team"), month.alias("month"), "use_case_id").agg(F.sum(cost).alias("nano"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    best = by_case.withColumn("r", F.row_number().over(Window.partitionBy("team", "month").orderBy(F.desc("nano"), "use_case_id"))).where("r = 1").select("team", "month", F.col("use_case_id").alias("top_use_case"))
    total = by_case.groupBy("team", "month").agg(F.sum("nano").alias("nano"), F.sum("tokens").alias("tokens"))
    before = F.lag("nano").over(Window.partitionBy("team").orderBy("month"))
    out = total.withColumn("before", before).join(best, ["team", "month"])
    return out.select("team", "month", half_up(usd(F.col("nano")), 2).alias("spend_usd"), (F.col("tokens") / 1e6).alias("tokens_m"), F.when(F.col("before") > 0, half_up((F.col("nano") - F.col("before")) / F.col("before"), 4)).alias("growth"), "top_use_case")


def spend_by_vendor(rows: DataFrame) -> DataFrame:
    """vendor, spend, its share of all, dollars for 1,000 tokens (0 without tokens)."""
    total = rows.groupBy(F.coalesce("vendor", F.lit("unknown")).alias("vendor")).agg(F.sum(F.coalesce("nano", F.lit(0))).alias("nano"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = total.withColumn("all_nano", F.sum("nano").over(everything))
    return out.select(
        "vendor", half_up(usd(F.col("nano")), 2).alias("spend_usd"), (F.col("nano") / F.when(F.col("all_nano") != 0, F.col("all_nano"))).alias("share"), F.when(F.col("tokens") > 0, half_up(F.col("nano") / F.col("tokens") / 1e6, 6)).otherwise(0.0).alias("usd_per_1k")
    )


def ops_kpis(rows: DataFrame, checks: DataFrame, now: str) -> DataFrame:
    """One row: receipts, failures and the verification failure rate of the last day, active vendors, chain breaks of a week, latency percentiles, top tenants.

    checks: receipt_id, link_ok, valid of every receipt (verify_links, verify_envelopes); one without counts as failed.
    Percentiles are exact and taken from the counts of whole milliseconds, not from the receipts. top_tenants: the ten
    with most receipts of the day, as tenant:count.
    """
    at = F.lit(now).cast("timestamp_ntz")
    day, week = F.col("ts") > at - F.expr("interval 24 hours"), F.col("ts") > at - F.expr("interval 7 days")
    ok = lambda c: F.coalesce(c, F.lit(False))
    slim = rows.select("receipt_id", "tenant_id", "ts", "outcome", "vendor").join(checks.select("receipt_id", "link_ok", "valid"), "receipt_id", "left")
    one = slim.agg(
        F.count_if(day).alias("receipts_24h"),
        F.count_if(day & (F.col("outcome") == "error")).alias("errors_24h"),
        share(F.count_if(day & ~ok(F.col("valid"))), F.count_if(day)).alias("verification_failure_rate"),
        F.countDistinct(F.when(day, F.col("vendor"))).alias("active_vendors"),
        F.count_if(week & ~ok(F.col("link_ok"))).alias("chain_breaks_7d"),
    )
    counts = rows.where("latency_ms is not null").groupBy("latency_ms").agg(F.count(F.lit(1)).alias("n"))
    percentiles = counts.agg(*[half_up(F.percentile("latency_ms", F.lit(q), F.col("n")), 1).alias(f"latency_p{round(q * 100)}") for q in (0.5, 0.95, 0.99)])
    tenants = rows.where(day).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tenant_id").limit(10)
    top = tenants.agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "tenant_id"))), lambda x: F.concat(x["tenant_id"], F.lit(":"), -x["k"]))).alias("top_tenants"))
    return one.join(percentiles).join(top)


#: Size of the latency sketches; a rank that they give is off by 2.296 / SKETCH**0.9723 of all at most, in 99 of 100 cases.
SKETCH = 800


def latency_sketches(rows: DataFrame, k: int = SKETCH) -> DataFrame:
    """tenant_id, hour, receipts, sketch (a quantile sketch of latency_ms) of each tenant's hour: what dashboards keep in place of receipts."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")
    return rows.where("latency_ms is not null").groupBy("tenant_id", hour).agg(F.count(F.lit(1)).alias("receipts"), F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), F.lit(k)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, *keys: str, since: str | None = None, until: str | None = None, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = SKETCH) -> DataFrame:
    """keys, quantile, receipts, latency_ms, rank_error of any period (hours since <= hour < until) and any keys, merged from hourly sketches. No receipt is read."""
    held = sketches if since is None else sketches.where(F.col("hour") >= F.lit(since).cast("timestamp"))
    held = held if until is None else held.where(F.col("hour") < F.lit(until).cast("timestamp"))
    merged = held.groupBy(*keys).agg(F.sum("receipts").alias("receipts"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("s"))
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias("latency_ms")) for q in quantiles]))
    return merged.where("receipts > 0").select(*keys, "receipts", each.alias("x")).select(*keys, "x.quantile", "receipts", "x.latency_ms", F.lit(2.296 / k**0.9723).alias("rank_error"))


def list_receipts(rows: DataFrame, tenant: str, limit: int, offset: int) -> DataFrame:
    """A page of one tenant's receipts, greatest height first."""
    return for_tenant(rows, tenant).orderBy(F.desc("chain_height"), "receipt_id").offset(offset).limit(limit)


def for_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """The rows of one tenant; a null or empty tenant reads nothing."""
    return rows.where(F.col("tenant_id") == tenant) if tenant else rows.where(F.lit(False))


def cross_tenant_attempts(access: DataFrame) -> DataFrame:
    """session_tenant, requested_tenant, attempts where they differ; null sessions count as differing."""
    met = access.where(~F.col("session_tenant").eqNullSafe(F.col("requested_tenant")))
    return met.groupBy("session_tenant", "requested_tenant").agg(F.count(F.lit(1)).alias("attempts"))
