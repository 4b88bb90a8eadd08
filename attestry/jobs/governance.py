"""Jobs over registries, regulators, reviews, alerts and dashboard views, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions.tables import written
from attestry.jobs import ledger, texts
from attestry.jobs.catalog import query
from attestry.jobs.spend import _PRICED, OVER, priced
from attestry.operators import governance as op
from attestry.operators import ledger as chain
from attestry.operators import spend
from attestry.sources import dims, receipts

NOW = "2024-01-30T23:00:00Z"


def rows_of(spark, sf_dir):
    return receipts.core(spark, sf_dir)


def chained(spark, sf_dir):
    return receipts.receipts(spark, sf_dir)


def _up(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0::DOUBLE ELSE {_up(f'({a}) / ({b})::DOUBLE')} END"


_KEY_OK = "coalesce(status = 'active' OR (status = 'retired' AND captured_at <= retired_at), false)"


@query("keys_valid_at", f"SELECT kid, {_KEY_OK} AS key_ok, count(*) AS receipts, min(receipt_id) AS first_receipt FROM receipts LEFT JOIN signing_keys USING (kid) GROUP BY ALL", "receipts", "signing_keys")
def keys_valid_at(spark, sf_dir):
    found = op.keys_valid_at(rows_of(spark, sf_dir), dims.table(spark, "signing_keys"))
    return found.groupBy("kid", "key_ok").agg(F.count(F.lit(1)).alias("receipts"), F.min("receipt_id").alias("first_receipt"))


_WINDOWS = """windows AS (SELECT 'kid-' || CAST(k AS VARCHAR) AS kid, TIMESTAMP '2024-01-01 00:00:00' + to_hours(n * 41 + k * 7) AS valid_from, CASE WHEN n % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(n * 41 + k * 7 + 30) END AS valid_until,
  CASE WHEN n % 7 = 5 THEN 'revoked' WHEN n % 2 = 0 THEN 'active' ELSE 'retired' END AS status FROM range(3) AS a(k), range(1, 16) AS b(n))"""


@query("keys_as_of", f"""WITH {_WINDOWS}, met AS (SELECT receipt_id, ts, r.kid, max(valid_from) AS valid_from FROM receipts r LEFT JOIN windows w ON w.kid = r.kid AND w.valid_from <= date_trunc('second', ts) GROUP BY ALL)
SELECT receipt_id, status AS key_status, coalesce(status IN ('active', 'retired') AND (valid_until IS NULL OR date_trunc('second', ts) <= valid_until), false) AS key_ok FROM met LEFT JOIN windows USING (kid, valid_from)""", "receipts")
def keys_as_of(spark, sf_dir):
    """Keys that rotate every 41 hours: windows with and without an end, retired and revoked ones; kid-3 has none."""
    hour = lambda h: (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), h.cast("int")))
    n, k = F.col("n"), F.col("k")
    begun = n * 41 + k * 7
    windows = spark.range(3).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(15))).alias("n")).select(
        F.concat(F.lit("kid-"), k.cast("string")).alias("kid"), hour(begun).alias("valid_from"), F.when(n % 3 == 0, hour(begun + 30)).alias("valid_until"),
        F.when(n % 7 == 5, "revoked").when(n % 2 == 0, "active").otherwise("retired").alias("status"),
    )
    return op.keys_as_of(rows_of(spark, sf_dir), windows).select("receipt_id", "key_status", "key_ok")


_PRESENT = (
    "WITH present AS (SELECT receipt_id, list_filter(["
    + ", ".join(f"CASE WHEN {e} THEN '{p}' END" for p, e in op.PATHS.items())
    + f"], lambda x: x IS NOT NULL) AS paths FROM receipts), cited AS (SELECT receipt_id, framework, regulator, article_id, severity, {_up('len(list_intersect(fields, paths)) / len(fields)::DOUBLE', 2)} AS confidence "
    "FROM present, articles WHERE len(list_intersect(fields, paths)) > 0) "
)


@query("cite_receipts", _PRESENT + "SELECT receipt_id, regulator, count(*) AS citations, CAST(sum(round(confidence * 100)) AS BIGINT) AS points FROM cited GROUP BY ALL", "receipts", "articles")
def cite_receipts(spark, sf_dir):
    found = op.cite_receipts(chained(spark, sf_dir), dims.table(spark, "articles"))
    return found.groupBy("receipt_id", "regulator").agg(F.count(F.lit(1)).alias("citations"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("points"))


@query(
    "regulator_coverage",
    _PRESENT
    + f"""SELECT framework, count(receipt_id) AS citations, {_share('coalesce(sum(CAST(round(confidence * 100) AS BIGINT)), 0) / 100.0::DOUBLE', 'count(receipt_id)')} AS confidence, count(DISTINCT c.article_id) AS articles_satisfied,
  any_value(t.n) AS articles_total FROM (SELECT framework, count(*) AS n FROM articles GROUP BY 1) t LEFT JOIN cited c USING (framework) GROUP BY framework""",
    "receipts",
    "articles",
)
def regulator_coverage(spark, sf_dir):
    articles = dims.table(spark, "articles")
    return op.regulator_coverage(op.cite_receipts(chained(spark, sf_dir), articles), articles)


@query("compliance_gaps", _PRESENT + """SELECT framework, article_id, field, severity, (SELECT count(*) FROM present) - (SELECT count(*) FROM present p WHERE list_contains(p.paths, field)) AS missing
  FROM (SELECT framework, article_id, severity, unnest(fields) AS field FROM articles) WHERE missing > 0""", "receipts", "articles")
def compliance_gaps(spark, sf_dir):
    return op.compliance_gaps(chained(spark, sf_dir), dims.table(spark, "articles"))


@query("validate_use_case", """WITH j AS (SELECT receipt_id, CASE WHEN u.status IS NULL THEN 'unknown_use_case:' || r.use_case_id WHEN u.status IN ('retired', 'deprecated') THEN 'use_case_lifecycle:' || u.status ELSE concat_ws(',',
  CASE WHEN model IS NOT NULL AND NOT list_contains(models, model) THEN 'model_not_approved_for_use_case' END, CASE WHEN len(sources) > 0 AND NOT list_contains(sources, app) THEN 'source_not_approved_for_use_case' END,
  CASE WHEN NOT list_contains(classes, input_class) THEN 'data_classification_above_approved_tier' END) END AS reasons FROM receipts r LEFT JOIN use_cases u USING (use_case_id)) SELECT receipt_id, reasons = '' AS ok, reasons FROM j""", "receipts", "use_cases")
def validate_use_case(spark, sf_dir):
    return op.validate_use_case(rows_of(spark, sf_dir), dims.table(spark, "use_cases"))


@query("validate_model_assignment", """SELECT receipt_id, CASE WHEN m.status IS NULL THEN 'unknown_model' WHEN m.status = 'revoked' THEN 'model_revoked' WHEN m.status = 'retired' THEN 'model_retired'
  WHEN m.status IN ('development', 'validation') THEN 'model_not_production_ready:' || m.status WHEN NOT list_contains(use_cases, use_case_id) THEN 'model_not_approved_for_use_case' END AS reason
  FROM receipts LEFT JOIN model_registry m USING (model) WHERE model IS NOT NULL""", "receipts", "model_registry")
def validate_model_assignment(spark, sf_dir):
    return op.validate_model_assignment(rows_of(spark, sf_dir), dims.table(spark, "model_registry"))


@query("unlogged_receipts", "SELECT receipt_id, tenant_id FROM receipts WHERE receipt_id NOT IN (SELECT receipt_id FROM receipts WHERE event_id % 5 <> 0)", "receipts")
def unlogged_receipts(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return op.unlogged_receipts(rows, rows.where("event_id % 5 <> 0"))


@query("missing_policy_bundles", "SELECT receipt_id, 'bundle-' || CAST(event_id % 13 AS VARCHAR) AS bundle_hash FROM receipts WHERE event_id % 13 NOT IN (SELECT DISTINCT user_id % 13 FROM receipts WHERE user_id < 9)", "receipts")
def missing_policy_bundles(spark, sf_dir):
    rows = rows_of(spark, sf_dir).withColumn("bundle_hash", F.concat(F.lit("bundle-"), F.col("event_id") % 13))
    bundles = rows.where("user_id < 9").select(F.concat(F.lit("bundle-"), F.col("user_id") % 13).alias("bundle_hash")).distinct()
    return op.missing_policy_bundles(rows, bundles)


@query("dedup_captures", """WITH twice AS (SELECT tenant_id, 'req-' || receipt_id AS request_id, receipt_id, captured_at FROM receipts UNION ALL SELECT tenant_id, 'req-' || receipt_id, receipt_id || '-again', strftime(ts + INTERVAL 5 SECOND, '%Y-%m-%dT%H:%M:%SZ') FROM receipts WHERE event_id % 20 = 0)
SELECT tenant_id, request_id, arg_min(receipt_id, captured_at || receipt_id) AS receipt_id FROM twice GROUP BY 1, 2""", "receipts")
def dedup_captures(spark, sf_dir):
    rows = rows_of(spark, sf_dir).withColumn("request_id", F.concat(F.lit("req-"), "receipt_id"))
    later = rows.where("event_id % 20 = 0").withColumn("receipt_id", F.concat("receipt_id", F.lit("-again"))).withColumn("captured_at", F.date_format(F.col("ts") + F.expr("interval 5 seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    both = rows.select("tenant_id", "request_id", "receipt_id", "captured_at").unionByName(later.select("tenant_id", "request_id", "receipt_id", "captured_at"))
    return op.dedup_captures(both, "tenant_id", "request_id").select("tenant_id", "request_id", "receipt_id")


_CHECKED = """WITH checked AS (SELECT v.tenant_id, v.action_hash, line, kid, reviewer, verdict, expires_at > '1999-06-01T00:00:00Z' AND reviewer <> actor AS valid FROM verdicts v JOIN actions a USING (tenant_id, action_hash)) """


def checked(spark, sf_dir):
    return op.actions_cleared(receipts.table(spark, sf_dir, "actions"), receipts.table(spark, sf_dir, "verdicts"), "1999-06-01T00:00:00Z")


@query("actions_cleared", _CHECKED + "SELECT *, valid AND verdict = 'approve' AS cleared FROM checked", "verdicts", "actions")
def actions_cleared(spark, sf_dir):
    return checked(spark, sf_dir)


@query("review_n_of_m", _CHECKED + """, k AS (SELECT tenant_id, action_hash, kid, count(*) FILTER (verdict = 'approve') AS yes, count(*) FILTER (verdict = 'reject') AS no, count(DISTINCT reviewer) FILTER (verdict = 'approve') AS names FROM checked WHERE valid GROUP BY ALL)
SELECT tenant_id, action_hash, count(*) FILTER (yes > 0) AS approvals, CAST(sum(no) AS BIGINT) AS rejects, count(*) FILTER (names > 1) AS shared_keys, sum(no) = 0 AND count(*) FILTER (yes > 0) >= 2 AS cleared FROM k GROUP BY ALL""", "verdicts", "actions")
def review_n_of_m(spark, sf_dir):
    return op.review_n_of_m(checked(spark, sf_dir))


@query("approval_status", """WITH req AS (SELECT action_hash AS request, requested_ts + INTERVAL 365 DAY AS deadline_ts FROM actions),
dec AS (SELECT action_hash AS request, reviewer AS approver, CASE WHEN verdict = 'reject' THEN 'reject' ELSE 'approve' END AS decision, decided_ts AS ts, line AS seq FROM verdicts),
one AS (SELECT d.*, row_number() OVER (PARTITION BY d.request, approver ORDER BY ts, seq) AS r FROM dec d JOIN req USING (request) WHERE ts < deadline_ts),
ran AS (SELECT *, row_number() OVER w AS pos, count(*) FILTER (decision = 'approve') OVER w AS yes FROM one WHERE r = 1 WINDOW w AS (PARTITION BY request ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
e AS (SELECT request, min(pos) FILTER (decision = 'reject') AS no_pos, arg_min(ts, pos) FILTER (decision = 'reject') AS no_ts, min(pos) FILTER (decision = 'approve' AND yes >= 2) AS yes_pos, arg_min(ts, pos) FILTER (decision = 'approve' AND yes >= 2) AS yes_ts FROM ran GROUP BY 1)
SELECT request, CASE WHEN yes_pos IS NOT NULL AND (no_pos IS NULL OR yes_pos < no_pos) THEN 'approved' WHEN no_pos IS NOT NULL THEN 'rejected' ELSE 'expired' END AS status,
  CASE WHEN yes_pos IS NOT NULL AND (no_pos IS NULL OR yes_pos < no_pos) THEN yes_ts WHEN no_pos IS NOT NULL THEN no_ts ELSE deadline_ts END AS decided_ts FROM req LEFT JOIN e USING (request)""", "verdicts", "actions")
def approval_status(spark, sf_dir):
    asked = receipts.table(spark, sf_dir, "actions").select(F.col("action_hash").alias("request"), (F.col("requested_ts") + F.expr("interval 365 days")).alias("deadline_ts"))
    decision = F.when(F.col("verdict") == "reject", "reject").otherwise("approve")
    told = receipts.table(spark, sf_dir, "verdicts").select(F.col("action_hash").alias("request"), F.col("reviewer").alias("approver"), decision.alias("decision"), F.col("decided_ts").alias("ts"), F.col("line").alias("seq"))
    return op.approval_status(asked, told)


# The states of a capture pipeline in order.
_STATES = ["received", "validated", "sealed", "signed", "stored"]


@query("invalid_transitions", """WITH log AS (SELECT workflow_id AS subject, chain_height AS seq, (chain_height - 1) % 4 AS k, event_id FROM receipts),
s AS (SELECT subject, seq, CASE k WHEN 0 THEN 'received' WHEN 1 THEN 'validated' WHEN 2 THEN 'sealed' ELSE 'signed' END AS from_state, CASE WHEN event_id % 89 = 0 THEN 'received' WHEN k = 0 THEN 'validated' WHEN k = 1 THEN 'sealed' WHEN k = 2 THEN 'signed' ELSE 'stored' END AS to_state FROM log),
l AS (SELECT *, lag(to_state) OVER (PARTITION BY subject ORDER BY seq) AS last FROM s)
SELECT subject, seq, from_state, to_state, why FROM (SELECT *, CASE WHEN (from_state || '>' || to_state) NOT IN ('received>validated', 'validated>sealed', 'sealed>signed', 'signed>stored') THEN 'not_permitted' WHEN last IS NOT NULL AND last <> from_state THEN 'broken_sequence' END AS why FROM l) WHERE why IS NOT NULL""", "receipts")
def invalid_transitions(spark, sf_dir):
    states = F.array(*[F.lit(s) for s in _STATES])
    k = ((F.col("chain_height") - 1) % 4).cast("int")
    log = chained(spark, sf_dir).select(
        F.col("workflow_id").alias("subject"), F.col("chain_height").alias("seq"), F.get(states, k).alias("from_state"), F.when(F.col("event_id") % 89 == 0, F.lit("received")).otherwise(F.get(states, k + 1)).alias("to_state")
    )
    return op.invalid_transitions(log, spark.createDataFrame(list(zip(_STATES[:-1], _STATES[1:], strict=True)), "from_state string, to_state string"))


_SAMPLE = "(SELECT string_agg(receipt_id, ',' ORDER BY receipt_id) FROM (SELECT receipt_id FROM receipts s WHERE {} ORDER BY receipt_id LIMIT {}))"


@query("model_inventory", f"""WITH g AS (SELECT model, count(*) AS invocations, count(DISTINCT tenant_id) AS distinct_tenants, {_share("count(*) FILTER (decision = 'block')", 'count(*)')} AS block_rate, {_share("count(*) FILTER (decision = 'flag')", 'count(*)')} AS flag_rate,
  {_share("count(*) FILTER (outcome = 'error')", 'count(*)')} AS error_rate, string_agg(DISTINCT use_case_id, ',' ORDER BY use_case_id) AS use_cases FROM receipts WHERE model IS NOT NULL GROUP BY model),
n AS (SELECT model, string_agg(receipt_id, ',' ORDER BY receipt_id) AS sample FROM (SELECT model, receipt_id, row_number() OVER (PARTITION BY model ORDER BY receipt_id) AS r FROM receipts WHERE model IS NOT NULL) WHERE r <= 5 GROUP BY 1)
SELECT * FROM g JOIN n USING (model)""", "receipts")
def model_inventory(spark, sf_dir):
    return op.model_inventory(rows_of(spark, sf_dir))


@query("use_case_inventory", "SELECT use_case_id, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models, count(*) AS invocations FROM receipts GROUP BY 1", "receipts")
def use_case_inventory(spark, sf_dir):
    return op.use_case_inventory(rows_of(spark, sf_dir))


@query("monitoring_summary", f"SELECT count(*) AS invocations, count(*) FILTER (decision = 'block') AS blocks, count(*) FILTER (decision = 'flag') AS flags, count(*) FILTER (outcome = 'error') AS errors, {_share('count(*) FILTER (len(applied_policies) > 0)', 'count(*)')} AS coverage FROM receipts", "receipts")
def monitoring_summary(spark, sf_dir):
    return op.monitoring_summary(rows_of(spark, sf_dir))


@query("validation_activities", " UNION ALL ".join(f"SELECT '{n}' AS activity, count(*) AS receipts, {_SAMPLE.format(m, k)} AS sample FROM receipts WHERE {m}" for n, m, k in (("human_review", "reviewer <> 'pending'", 10), ("guardrail_sampling", "outcome = 'guardrail_block'", 10), ("citation_completeness", "len(applied_policies) = 0", 5))), "receipts")
def validation_activities(spark, sf_dir):
    return op.validation_activities(rows_of(spark, sf_dir))


@query("model_findings", f"""WITH g AS (SELECT model, {_share("count(*) FILTER (decision = 'flag')", 'count(*)')} AS flag_rate, {_share("count(*) FILTER (outcome = 'error')", 'count(*)')} AS error_rate FROM receipts WHERE model IS NOT NULL GROUP BY model),
e AS (SELECT model, 'high' AS severity, receipt_id FROM receipts WHERE outcome = 'error' UNION ALL SELECT model, 'medium', receipt_id FROM receipts WHERE decision = 'flag'),
n AS (SELECT model, severity, string_agg(receipt_id, ',' ORDER BY receipt_id) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY model, severity ORDER BY receipt_id) AS r FROM e WHERE model IS NOT NULL) WHERE r <= 10 GROUP BY 1, 2)
SELECT f.model, f.severity, f.rate, n.evidence FROM (SELECT model, 'high' AS severity, error_rate AS rate FROM g WHERE error_rate > 0.05 UNION ALL SELECT model, 'medium', flag_rate FROM g WHERE flag_rate > 0.1) f LEFT JOIN n USING (model, severity)""", "receipts")
def model_findings(spark, sf_dir):
    return op.model_findings(rows_of(spark, sf_dir))


_ALERTS = "alerts AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{s}' AS severity, receipt_id FROM receipts WHERE {p}" for r, s, p in op.ALERT_RULES) + ")"


@query("alert_rules_per_receipt", f"WITH {_ALERTS} SELECT * FROM alerts", "receipts")
def alert_rules_per_receipt(spark, sf_dir):
    return op.alert_rules_per_receipt(rows_of(spark, sf_dir))


def suggestions(spark, sf_dir):
    return spend.over_tiering(priced(spark, sf_dir), dims.table(spark, "tiers"), dims.table(spark, "pricing"))


@query("alert_over_tiering", OVER + "SELECT 'over-tiering' AS rule, 'medium' AS severity, receipt_id FROM receipts WHERE (model, app) IN (SELECT (model, app) FROM over_tiered)", "receipts", "pricing", "tiers")
def alert_over_tiering(spark, sf_dir):
    return op.alert_over_tiering(rows_of(spark, sf_dir), suggestions(spark, sf_dir))


@query("run_alerts", OVER + f""", {_ALERTS}, every AS (SELECT * FROM alerts UNION ALL SELECT 'over-tiering', 'medium', receipt_id FROM receipts WHERE (model, app) IN (SELECT (model, app) FROM over_tiered)),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY receipt_id) AS n FROM every)
SELECT rule, severity, count(*) AS receipts, string_agg(receipt_id, ',' ORDER BY receipt_id) FILTER (n <= 20) AS sample FROM r GROUP BY 1, 2""", "receipts", "pricing", "tiers")
def run_alerts(spark, sf_dir):
    def broken(_):
        raise RuntimeError("a rule that can't be planned")

    tiered = suggestions(spark, sf_dir)
    return op.run_alerts(rows_of(spark, sf_dir), [broken, lambda rows: op.alert_over_tiering(rows, tiered)])


_WEEK = "strftime(date_trunc('week', ts), '%Y-%m-%d')"
_TENANTS = f"""f AS (SELECT tenant_id, {_WEEK} AS period, count(*) FILTER (outcome = 'error' AND decision = 'block') AS high_findings, count(*) FILTER (event_id % 499 = 0) % 3 AS incidents FROM receipts GROUP BY ALL),
g AS (SELECT tenant_id, period, count(DISTINCT p) AS covered FROM (SELECT tenant_id, {_WEEK} AS period, unnest(applied_policies) AS p FROM receipts) GROUP BY ALL)"""


@query("underwriting_exposure", f"""WITH {_TENANTS}, b AS (SELECT tenant_id, {_WEEK} AS period, count(*) AS receipts, {_share("count(*) FILTER (outcome = 'error')", 'count(*)')} AS error_rate, {_share("count(*) FILTER (decision = 'block')", 'count(*)')} AS block_rate, {_share('count(*) FILTER (signed)', 'count(*)')} AS controls_posture,
  {_up("1 - count(*) FILTER (outcome = 'error') / count(*)::DOUBLE")} AS uptime, count(DISTINCT model) AS models FROM receipts GROUP BY ALL),
c AS (SELECT tenant_id, period, receipts, error_rate, block_rate, controls_posture, {_up('error_rate * 0.2::DOUBLE * 100')} AS risk_error, {_up('block_rate * 0.1::DOUBLE * 100')} AS risk_block, {_up('coalesce(high_findings, 0) / greatest(1, models)::DOUBLE * 0.15::DOUBLE * 100')} AS risk_findings,
  {_up('coalesce(incidents, 0)::DOUBLE * 0.15::DOUBLE * 100')} AS risk_incidents, {_up('(1 - controls_posture) * 0.15::DOUBLE * 100')} AS risk_posture, {_up('(1 - uptime) * 0.1::DOUBLE * 100')} AS risk_downtime, {_up('(1 - coalesce(covered, 0) / 6::DOUBLE) * 0.15::DOUBLE * 100')} AS risk_uncovered
  FROM b LEFT JOIN f USING (tenant_id, period) LEFT JOIN g USING (tenant_id, period)),
d AS (SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, {_up('0.0::DOUBLE + risk_error + risk_block + risk_findings + risk_incidents + risk_posture + risk_downtime + risk_uncovered')})) AS composite FROM c)
SELECT *, CASE WHEN composite <= 20 THEN 'A' WHEN composite <= 35 THEN 'B' WHEN composite <= 55 THEN 'C' WHEN composite <= 75 THEN 'D' ELSE 'E' END AS carrier_class FROM d""", "receipts")
def underwriting_exposure(spark, sf_dir):
    """By week."""
    rows = rows_of(spark, sf_dir).withColumn("period", F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd"))
    key = ["tenant_id", "period"]
    findings = rows.groupBy(*key).agg(F.count_if((F.col("outcome") == "error") & (F.col("decision") == "block")).alias("high_findings"), (F.count_if(F.col("event_id") % 499 == 0) % 3).alias("incidents"))
    covered = rows.select(*key, F.explode("applied_policies").alias("p")).groupBy(*key).agg(F.countDistinct("p").alias("covered"))
    return op.underwriting_exposure(rows, findings, covered)


def _sub(a: str, b: str, empty: int) -> str:
    return f"CASE WHEN {b} = 0 THEN {empty}::DOUBLE ELSE {_up(f'greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * {a} / {b}))', 1)} END"


@query("receipt_score", f"""WITH k AS (SELECT tenant_id, count(*) AS invocations, count(*) FILTER (signed) AS with_receipt, count(*) FILTER (signed AND NOT ({ledger._BAD})) AS verified, count(*) FILTER (signed) AS checked, count(*) FILTER (outcome <> 'success') AS findings,
  count(*) FILTER (outcome <> 'success' AND decision IS NOT NULL) AS handled, count(*) FILTER (signed AND event_id % 5 <> 0) AS logged FROM receipts GROUP BY 1), g AS (SELECT tenant_id, count(DISTINCT p) AS covered FROM (SELECT tenant_id, unnest(applied_policies) AS p FROM receipts) GROUP BY 1),
s AS (SELECT tenant_id, {_sub('with_receipt', 'invocations', 0)} AS coverage, {_sub('verified', 'checked', 0)} AS verification, {_sub('handled', 'findings', 100)} AS safety, {_up('least(100.0::DOUBLE, 100.0::DOUBLE * coalesce(covered, 0) / 5)', 1)} AS regulatory, {_sub('logged', 'with_receipt', 0)} AS transparency FROM k LEFT JOIN g USING (tenant_id)),
t AS (SELECT *, {_up('coverage * 0.25::DOUBLE + verification * 0.25::DOUBLE + safety * 0.2::DOUBLE + regulatory * 0.15::DOUBLE + transparency * 0.15::DOUBLE', 1)} AS score FROM s)
SELECT *, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM t""", "receipts")
def receipt_score(spark, sf_dir):
    """Verification from the envelopes' checks; the log holds four of five receipts."""
    rows = rows_of(spark, sf_dir)
    checks = chain.verify_envelopes(ledger.envelopes(spark, sf_dir), ledger.public_keys())
    return op.receipt_score(op.score_counters(rows, checks, rows.where("event_id % 5 <> 0").select("receipt_id")))


_BENCH = f"""WITH s AS (SELECT vendor, model, count(*) AS invocations, count(*) FILTER (decision = 'block') AS blocked, count(*) FILTER (decision = 'flag') AS flagged, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (reviewer <> 'pending') AS reviewed,
  CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, count(*) FILTER (outcome = 'error' AND decision = 'block') AS severe FROM receipts WHERE model IS NOT NULL GROUP BY ALL),
v AS (SELECT vendor, model, invocations, {_share('flagged + errors', 'invocations')} AS hallucination_proxy, {_up('(i * nano_in + o * nano_out) / 1e9::DOUBLE / greatest(1, invocations - errors - blocked)')} AS cost_per_outcome_usd, {_share('reviewed', 'invocations')} AS compliance_posture,
  {_up('least(1.0::DOUBLE, severe / 10::DOUBLE)')} AS supply_chain_risk FROM s LEFT JOIN pricing USING (vendor, model)),
bench AS (SELECT *, CASE WHEN cost_per_outcome_usd IS NOT NULL THEN {_up('hallucination_proxy * 40 + least(1.0::DOUBLE, cost_per_outcome_usd * 1000) * 20 + (1 - compliance_posture) * 20 + supply_chain_risk * 20')} END AS composite FROM v) """


_VERDICTS = texts._SAFE.removeprefix("WITH ") + """, r AS (SELECT *, least(10000, 50 * shadow_points + 35 * deviation_points + CASE WHEN event_id % 23 = 0 THEN 2500 ELSE 0 END + CASE WHEN event_id % 19 = 0 THEN 1000 ELSE 0 END) AS points FROM p),
judged AS (SELECT receipt_id, list_contains(sha, 'consumer_endpoint') OR vendor IS NULL OR list_contains(dev, 'pii_leaked_to_public_surface') OR points >= 3000 AS found FROM r)"""


@query("receipt_score_checked", _PRESENT.rstrip() + ", " + _VERDICTS + f""", k AS (SELECT tenant_id, count(*) AS invocations, count(*) FILTER (signed) AS with_receipt, count(*) FILTER (signed AND NOT ({ledger._BAD})) AS verified, count(*) FILTER (signed) AS checked, count(*) FILTER (found) AS findings,
  count(*) FILTER (found AND decision IS NOT NULL) AS handled, count(*) FILTER (signed AND event_id % 5 <> 0) AS logged FROM receipts JOIN judged USING (receipt_id) GROUP BY 1),
g AS (SELECT tenant_id, count(DISTINCT framework) AS covered FROM receipts JOIN cited USING (receipt_id) WHERE framework IN ('CBUAE', 'EU_AI_ACT', 'SAMA', 'ISO_42001', 'NIST_AI_RMF') GROUP BY 1),
s AS (SELECT tenant_id, {_sub('with_receipt', 'invocations', 0)} AS coverage, {_sub('verified', 'checked', 0)} AS verification, {_sub('handled', 'findings', 100)} AS safety, {_up('least(100.0::DOUBLE, 100.0::DOUBLE * coalesce(covered, 0) / 5)', 1)} AS regulatory, {_sub('logged', 'with_receipt', 0)} AS transparency FROM k LEFT JOIN g USING (tenant_id)),
t AS (SELECT *, {_up('coverage * 0.25::DOUBLE + verification * 0.25::DOUBLE + safety * 0.2::DOUBLE + regulatory * 0.15::DOUBLE + transparency * 0.15::DOUBLE', 1)} AS score FROM s)
SELECT *, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM t""", "receipts", "articles")
def receipt_score_checked(spark, sf_dir):
    """The score with findings from the safety verdicts and regulators from the citations."""
    rows = chained(spark, sf_dir)
    checks = chain.verify_envelopes(ledger.envelopes(spark, sf_dir), ledger.public_keys())
    cited = op.cite_receipts(rows, dims.table(spark, "articles"))
    return op.receipt_score(op.score_counters(rows, checks, rows.where("event_id % 5 <> 0").select("receipt_id"), texts.safety_verdict(spark, sf_dir), cited))


@query("vendor_benchmark", _BENCH + "SELECT * FROM bench", "receipts", "pricing")
def vendor_benchmark(spark, sf_dir):
    return op.vendor_benchmark(rows_of(spark, sf_dir), dims.table(spark, "pricing"))


@query("rank_vendors", _BENCH + """, l AS (SELECT 'hallucination' AS ranking, vendor, model, hallucination_proxy AS v FROM bench UNION ALL SELECT 'cost_per_outcome', vendor, model, cost_per_outcome_usd FROM bench WHERE cost_per_outcome_usd IS NOT NULL
  UNION ALL SELECT 'compliance_posture', vendor, model, -compliance_posture FROM bench UNION ALL SELECT 'supply_chain', vendor, model, supply_chain_risk FROM bench UNION ALL SELECT 'cost_unknown', vendor, model, 0 FROM bench WHERE cost_per_outcome_usd IS NULL)
SELECT ranking, vendor, model, CAST(row_number() OVER (PARTITION BY ranking ORDER BY v, vendor, model) AS INT) AS place FROM l""", "receipts", "pricing")
def rank_vendors(spark, sf_dir):
    return op.rank_vendors(vendor_benchmark(spark, sf_dir))


@query("hr_violators", f"""SELECT user_name, team, count(*) AS events, CASE WHEN count(*) >= 4 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS severity, max(captured_at[1:16]) AS last_event FROM receipts
  WHERE ts > TIMESTAMP '{NOW[:10]} {NOW[11:19]}' - INTERVAL 7 DAY AND decision = 'block' GROUP BY 1, 2""", "receipts")
def hr_violators(spark, sf_dir):
    return op.hr_violators(rows_of(spark, sf_dir), f"{NOW[:10]} {NOW[11:19]}")


@query("hr_teams", f"SELECT team, count(DISTINCT user_name) AS users, count(*) FILTER (decision = 'block') AS violations_week FROM receipts WHERE ts > TIMESTAMP '{NOW[:10]} {NOW[11:19]}' - INTERVAL 7 DAY GROUP BY 1", "receipts")
def hr_teams(spark, sf_dir):
    return op.hr_teams(rows_of(spark, sf_dir), f"{NOW[:10]} {NOW[11:19]}")


@query("gdpr22_events", "SELECT receipt_id, captured_at[12:16] AS time, user_name AS subject, coalesce(model, 'unknown') AS model, coalesce(reviewer, 'pending') AS reviewed_by, coalesce(decision, 'pending') AS status FROM receipts WHERE list_contains(applied_policies, 'GDPR_ARTICLE_22')", "receipts")
def gdpr22_events(spark, sf_dir):
    return op.gdpr22_events(rows_of(spark, sf_dir))


@query("spend_by_team", _PRICED + f""", c AS (SELECT team, captured_at[1:7] AS month, use_case_id, CAST(sum(coalesce(nano, 0)) AS BIGINT) AS nano, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM priced GROUP BY ALL),
t AS (SELECT team, month, CAST(sum(nano) AS BIGINT) AS nano, CAST(sum(tokens) AS BIGINT) AS tokens, first(use_case_id ORDER BY nano DESC, use_case_id) AS top_use_case FROM c GROUP BY 1, 2), b AS (SELECT *, lag(nano) OVER (PARTITION BY team ORDER BY month) AS before FROM t)
SELECT team, month, {_up('nano / 1e9::DOUBLE', 2)} AS spend_usd, tokens / 1e6::DOUBLE AS tokens_m, CASE WHEN before > 0 THEN {_up('(nano - before) / before::DOUBLE')} END AS growth, top_use_case FROM b""", "receipts", "pricing")
def spend_by_team(spark, sf_dir):
    return op.spend_by_team(priced(spark, sf_dir))


@query("spend_by_vendor", _PRICED + f""", t AS (SELECT coalesce(vendor, 'unknown') AS vendor, CAST(sum(coalesce(nano, 0)) AS BIGINT) AS nano, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM priced GROUP BY 1)
SELECT vendor, {_up('nano / 1e9::DOUBLE', 2)} AS spend_usd, nano / CAST(sum(nano) OVER () AS DOUBLE) AS share, CASE WHEN tokens > 0 THEN {_up('nano / tokens::DOUBLE / 1e6::DOUBLE', 6)} ELSE 0 END AS usd_per_1k FROM t""", "receipts", "pricing")
def spend_by_vendor(spark, sf_dir):
    return op.spend_by_vendor(priced(spark, sf_dir))


@query("ops_kpis", f"""WITH l AS (SELECT *, ts > TIMESTAMP '{NOW[:10]} {NOW[11:19]}' - INTERVAL 24 HOUR AS d, ts > TIMESTAMP '{NOW[:10]} {NOW[11:19]}' - INTERVAL 7 DAY AS w, CASE WHEN chain_height = 1 THEN previous_receipt_hash = repeat('0', 64) ELSE coalesce(previous_receipt_hash = lag(receipt_hash) OVER (PARTITION BY tenant_id ORDER BY chain_height), false) END AS link_ok FROM receipts),
t AS (SELECT tenant_id, count(*) AS n FROM l WHERE d GROUP BY 1 ORDER BY n DESC, tenant_id LIMIT 10)
SELECT count(*) FILTER (d) AS receipts_24h, count(*) FILTER (d AND outcome = 'error') AS errors_24h, {_share(f"count(*) FILTER (d AND ({ledger._BAD}))", 'count(*) FILTER (d)')} AS verification_failure_rate, count(DISTINCT vendor) FILTER (d) AS active_vendors, count(*) FILTER (w AND NOT link_ok) AS chain_breaks_7d,
  {_up('quantile_cont(latency_ms, 0.5)', 1)} AS latency_p50, {_up('quantile_cont(latency_ms, 0.95)', 1)} AS latency_p95, {_up('quantile_cont(latency_ms, 0.99)', 1)} AS latency_p99, coalesce((SELECT string_agg(tenant_id || ':' || n, ',' ORDER BY n DESC, tenant_id) FROM t), '') AS top_tenants FROM l""", "receipts")
def ops_kpis(spark, sf_dir):
    rows = chained(spark, sf_dir)
    checks = chain.verify_envelopes(ledger.envelopes(spark, sf_dir), ledger.public_keys()).select("receipt_id", "valid")
    return op.ops_kpis(rows, chain.verify_links(rows).select("receipt_id", "link_ok").join(checks, "receipt_id"), f"{NOW[:10]} {NOW[11:19]}")


@query("latency_percentiles", "SELECT tenant_id, q AS quantile, count(*) AS receipts, true AS within FROM receipts, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) AS t(q) WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00' GROUP BY 1, 2", "receipts")
def latency_percentiles(spark, sf_dir):
    """Two weeks' percentiles of each tenant from its stored hourly sketches, and whether their ranks among the receipts are within twice the stated error."""
    rows = rows_of(spark, sf_dir)
    found = written(op.sketched_percentiles(written(op.latency_sketches(rows)), "tenant_id", since="2024-01-08", until="2024-01-22"))
    period = rows.where("ts >= timestamp_ntz'2024-01-08' and ts < timestamp_ntz'2024-01-22'").groupBy("tenant_id", F.col("latency_ms").alias("ms")).agg(F.count(F.lit(1)).alias("n"))
    ranks = period.join(F.broadcast(found), "tenant_id").groupBy("tenant_id", "quantile", "receipts", "rank_error").agg(F.sum(F.when(F.col("ms") < F.col("latency_ms"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("ms") <= F.col("latency_ms"), F.col("n")).otherwise(0)).alias("upto"))
    slack = 2 * F.col("rank_error")
    within = (F.col("below") / F.col("receipts") <= F.col("quantile") + slack) & (F.col("upto") / F.col("receipts") >= F.col("quantile") - slack)
    return ranks.select("tenant_id", "quantile", "receipts", within.alias("within"))


@query("list_receipts", "SELECT receipt_id, CAST(chain_height AS INT) AS chain_height FROM receipts WHERE tenant_id = 'tenant-0' ORDER BY chain_height DESC LIMIT 25 OFFSET 50", "receipts")
def list_receipts(spark, sf_dir):
    return op.list_receipts(chained(spark, sf_dir), "tenant-0", 25, 50).select("receipt_id", "chain_height")


@query("for_tenant", "SELECT tenant_id, receipt_id, receipt_hash FROM receipts WHERE tenant_id = 'tenant-7'", "receipts")
def for_tenant(spark, sf_dir):
    return op.for_tenant(chained(spark, sf_dir), "tenant-7").select("tenant_id", "receipt_id", "receipt_hash")


@query("cross_tenant_attempts", "SELECT 'tenant-' || CAST(user_id % 4 AS VARCHAR) AS session_tenant, tenant_id AS requested_tenant, count(*) AS attempts FROM receipts WHERE 'tenant-' || CAST(user_id % 4 AS VARCHAR) <> tenant_id GROUP BY ALL", "receipts")
def cross_tenant_attempts(spark, sf_dir):
    access = rows_of(spark, sf_dir).select(F.concat(F.lit("tenant-"), F.col("user_id") % 4).alias("session_tenant"), F.col("tenant_id").alias("requested_tenant"))
    return op.cross_tenant_attempts(access)
