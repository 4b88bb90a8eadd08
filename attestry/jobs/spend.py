"""Jobs over usage, cost, carbon and savings, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.jobs.catalog import query
from attestry.operators import spend as op
from attestry.sources import dims, receipts

_PRICED = "WITH priced AS (SELECT r.*, input_tokens * nano_in + output_tokens * nano_out AS nano FROM receipts r LEFT JOIN pricing USING (vendor, model)) "


def priced(spark, sf_dir, chain: bool = False):
    """Receipts with their cost; with their place in the chain only where a job asks for it."""
    return op.price_usage((receipts.receipts if chain else receipts.core)(spark, sf_dir), dims.table(spark, "pricing"))


@query("flatten_receipts", _PRICED + """SELECT receipt_id, tenant_id, captured_at, coalesce(vendor, 'unknown') AS vendor, coalesce(model, 'unknown') AS model, input_tokens, output_tokens,
  coalesce(nano, 0) / 1e9::DOUBLE AS cost_usd, nano IS NOT NULL AS priced, evidence_refs, signed, chain_height FROM priced""", "receipts", "pricing")
def flatten_receipts(spark, sf_dir):
    unknown = lambda x: F.coalesce(x, F.lit("unknown")).alias(x)
    cost = (F.coalesce("nano", F.lit(0)) / F.lit(1e9)).alias("cost_usd")
    return priced(spark, sf_dir, chain=True).select(
        "receipt_id", "tenant_id", "captured_at", unknown("vendor"), unknown("model"), "input_tokens", "output_tokens", cost, F.col("nano").isNotNull().alias("priced"), "evidence_refs", "signed", "chain_height"
    )


@query("price_usage", _PRICED + "SELECT receipt_id, nano FROM priced WHERE model IS NOT NULL", "receipts", "pricing")
def price_usage(spark, sf_dir):
    return priced(spark, sf_dir).where("model is not null").select("receipt_id", "nano")


_CACHED = """WITH used AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN input_tokens * 2 END AS cache_read_tokens, CASE WHEN event_id % 4 = 0 THEN input_tokens // 2 ELSE 0 END AS cache_write_tokens FROM receipts) """


def cached(spark, sf_dir):
    """Receipts whose prompts a cache gave in part (each third; others don't say) or kept in part (each fourth)."""
    id_, tokens = F.col("event_id"), F.col("input_tokens")
    return receipts.core(spark, sf_dir).withColumn("cache_read_tokens", F.when(id_ % 3 == 0, tokens * 2)).withColumn("cache_write_tokens", F.when(id_ % 4 == 0, F.floor(tokens / 2)).otherwise(0))


@query("price_usage_classes", _CACHED + """SELECT receipt_id, CAST(input_tokens * nano_in + output_tokens * nano_out + coalesce(cache_read_tokens, 0) * nano_read + cache_write_tokens * nano_write AS BIGINT) AS nano FROM used LEFT JOIN pricing USING (vendor, model) WHERE model IS NOT NULL""", "receipts", "pricing")
def price_usage_classes(spark, sf_dir):
    return op.price_usage(cached(spark, sf_dir), dims.table(spark, "pricing")).where("model is not null").select("receipt_id", "nano")


@query("cost_by_class", _CACHED + """, c AS (SELECT vendor, model, sum(input_tokens) AS i, sum(output_tokens) AS o, coalesce(sum(cache_read_tokens), 0) AS r, sum(cache_write_tokens) AS w FROM used WHERE model IS NOT NULL GROUP BY 1, 2),
p AS (SELECT c.*, nano_in, nano_out, nano_read, nano_write FROM c LEFT JOIN pricing USING (vendor, model)),
e AS (SELECT vendor, model, 'input' AS class, i AS tokens, i * nano_in AS nano FROM p UNION ALL SELECT vendor, model, 'output', o, o * nano_out FROM p UNION ALL SELECT vendor, model, 'cache_read', r, r * nano_read FROM p UNION ALL SELECT vendor, model, 'cache_write', w, w * nano_write FROM p)
SELECT vendor, model, class, CAST(tokens AS BIGINT) AS tokens, CAST(nano AS BIGINT) / 1e9::DOUBLE AS cost_usd FROM e""", "receipts", "pricing")
def cost_by_class(spark, sf_dir):
    return op.cost_by_class(cached(spark, sf_dir), dims.table(spark, "pricing"))


@query("filter_receipts", _PRICED + """SELECT receipt_id, nano FROM priced WHERE contains(lower(model), 'gpt') AND environment = 'production' AND captured_at >= '2024-01-05' AND captured_at <= '2024-01-25T12:00:00Z'
  AND coalesce(nano, 0) >= 1000000 AND (coalesce(input_class IN ('pii', 'pci', 'mnpi'), false) OR coalesce(output_class IN ('pii', 'pci', 'mnpi'), false)) AND evidence_refs > 0 AND signed
  AND contains(lower(concat_ws(' ', receipt_id, app, model, event_type, decision)), 'app-2')""", "receipts", "pricing")
def filter_receipts(spark, sf_dir):
    rows = priced(spark, sf_dir)
    found = op.filter_receipts(rows, model="GPT", environment="production", since="2024-01-05", until="2024-01-25T12:00:00Z", min_cost=1_000_000, sensitive=True, has_evidence=True, signed=True, text="APP-2")
    return found.select("receipt_id", "nano")


@query("query_receipts", _PRICED + """SELECT coalesce(model, 'unknown') AS key, count(*) AS count, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(coalesce(sum(nano), 0) AS BIGINT) / 1e9::DOUBLE AS cost_usd
  FROM priced GROUP BY 1 ORDER BY coalesce(sum(nano), 0) DESC, key LIMIT 5""", "receipts", "pricing")
def query_receipts(spark, sf_dir):
    return op.query_receipts(priced(spark, sf_dir), "model", "cost", 5)


_FOUND = "contains(lower(model), 'gpt') AND environment = 'production'"


@query("query_receipts_count", _PRICED + f"""SELECT count(*) AS matched, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(nano), 0) AS BIGINT) / 1e9::DOUBLE AS cost_usd, count(*) FILTER (nano IS NULL) AS unpriced,
  coalesce((SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT vendor || ':' || model AS m FROM priced WHERE nano IS NULL AND {_FOUND})), '') AS unpriced_models, (SELECT string_agg(receipt_id, ',' ORDER BY receipt_id) FROM (SELECT receipt_id FROM priced WHERE {_FOUND} ORDER BY 1 LIMIT 20)) AS citations FROM priced WHERE {_FOUND}""", "receipts", "pricing")
def query_receipts_count(spark, sf_dir):
    return op.query_totals(op.filter_receipts(priced(spark, sf_dir), model="GPT", environment="production"))


@query("query_receipts_list", _PRICED + f"SELECT receipt_id, captured_at, model, coalesce(nano, 0) / 1e9::DOUBLE AS cost_usd FROM priced WHERE {_FOUND} ORDER BY captured_at DESC, receipt_id LIMIT 15", "receipts", "pricing")
def query_receipts_list(spark, sf_dir):
    return op.query_list(op.filter_receipts(priced(spark, sf_dir), model="GPT", environment="production"), 15)


@query("unpriced_models", _PRICED + """SELECT count(*) FILTER (nano IS NULL AND model IS NOT NULL) AS unpriced,
  coalesce((SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT vendor || ':' || model AS m FROM priced WHERE nano IS NULL AND model IS NOT NULL)), '') AS models FROM priced""", "receipts", "pricing")
def unpriced_models(spark, sf_dir):
    return op.unpriced_models(priced(spark, sf_dir))


@query("summarize_totals", _PRICED + """SELECT count(*) AS receipts, count(model) AS requests, CAST(sum(input_tokens) FILTER (model IS NOT NULL) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) FILTER (model IS NOT NULL) AS BIGINT) AS output_tokens,
  CAST(sum(nano) AS BIGINT) / 1e9::DOUBLE AS cost_usd, count(nano) AS priced_requests, count(*) FILTER (model IS NOT NULL AND nano IS NULL) AS unpriced_requests,
  CAST(sum(input_tokens + output_tokens) FILTER (nano IS NOT NULL) AS BIGINT) AS priced_tokens, count(*) FILTER (signed) AS signed, CAST(max(chain_height) AS INT) AS max_chain_height,
  count(*) FILTER (evidence_refs > 0) AS with_evidence, min(captured_at) AS period_start, max(captured_at) AS period_end FROM priced""", "receipts", "pricing")
def summarize_totals(spark, sf_dir):
    return op.summarize_totals(priced(spark, sf_dir, chain=True))


def _by(keys: str) -> str:
    return _PRICED + f"""SELECT {keys}, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(coalesce(sum(nano), 0) AS BIGINT) / 1e9::DOUBLE AS cost_usd,
      count(*) FILTER (nano IS NULL) AS unpriced_requests FROM priced WHERE model IS NOT NULL GROUP BY ALL"""


@query("summarize_by_model", _by("vendor, model"), "receipts", "pricing")
def summarize_by_model(spark, sf_dir):
    return op.summarize_by(priced(spark, sf_dir), "vendor", "model")


@query("summarize_by_app", _by("app"), "receipts", "pricing")
def summarize_by_app(spark, sf_dir):
    return op.summarize_by(priced(spark, sf_dir), "app")


@query("summarize_by_environment", _by("environment"), "receipts", "pricing")
def summarize_by_environment(spark, sf_dir):
    return op.summarize_by(priced(spark, sf_dir), "environment")


OVER = _PRICED + """, light AS (SELECT vendor, model, app, cheaper, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(sum(nano) AS BIGINT) AS nano
  FROM priced JOIN tiers USING (vendor, model) WHERE premium AND decision IS NULL GROUP BY ALL),
over_tiered AS (SELECT l.vendor, l.model, l.app, l.cheaper, requests, nano / 1e9::DOUBLE AS cost_usd, (nano - (i * nano_in + o * nano_out)) / 1e9::DOUBLE AS savings_usd, CASE WHEN i <= 4000 * requests THEN 'high' ELSE 'review' END AS confidence
  FROM light l JOIN pricing p ON p.vendor = l.vendor AND p.model = l.cheaper WHERE requests >= 3 AND o <= 800 * requests AND i * nano_in + o * nano_out < nano) """


@query("over_tiering", OVER + "SELECT * FROM over_tiered", "receipts", "pricing", "tiers")
def over_tiering(spark, sf_dir):
    return op.over_tiering(priced(spark, sf_dir), dims.table(spark, "tiers"), dims.table(spark, "pricing"))


_NORMAL = """WITH named AS (SELECT *, CASE WHEN raw_model LIKE 'claude-opus-4-6-2%' THEN 'claude-opus-4-6' WHEN raw_model = 'claude-haiku-4.5' THEN 'claude-haiku-4-5' WHEN raw_model = 'gpt-5-2025-08-01' THEN 'gpt-5'
    WHEN raw_model LIKE 'GPT-5-nano%' THEN 'gpt-5-nano' WHEN raw_model LIKE 'gemini-2.5%' THEN replace(raw_model, '.', '-') ELSE raw_model END AS model FROM workloads),
normal AS (SELECT *, CASE WHEN model IN ('gpt-5-pro', 'claude-opus-4-6-thinking', 'mistral-large') THEN 'unknown' WHEN model LIKE 'claude%' THEN 'anthropic' WHEN model LIKE 'gpt%' THEN 'openai' ELSE 'google' END AS vendor FROM named) """


@query("normalize_model", _NORMAL + "SELECT DISTINCT raw_model, vendor, model FROM normal", "workloads")
def normalize_model(spark, sf_dir):
    vendor, model = op.normalize_model(F.col("raw_model"))
    return receipts.table(spark, sf_dir, "workloads").select("raw_model").distinct().select("raw_model", vendor.alias("vendor"), model.alias("model"))


@query("vendor_for_model", """SELECT raw_model, CASE WHEN starts_with(lower(raw_model), 'claude') THEN 'anthropic' WHEN starts_with(lower(raw_model), 'gpt') THEN 'openai' WHEN contains(lower(raw_model), 'gemini') THEN 'google' ELSE 'unknown' END AS vendor,
  count(*) AS n FROM workloads GROUP BY ALL""", "workloads")
def vendor_for_model(spark, sf_dir):
    return receipts.table(spark, sf_dir, "workloads").groupBy("raw_model").agg(F.count(F.lit(1)).alias("n")).select("raw_model", op.vendor_for_model(F.col("raw_model")).alias("vendor"), "n")


@query("summarize_workloads", _NORMAL + """, summed AS (SELECT vendor, model, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(input_total) AS BIGINT) AS input_tokens, CAST(sum(output_total) AS BIGINT) AS output_tokens FROM normal WHERE requests > 0 GROUP BY ALL)
SELECT vendor, model, requests, input_tokens, output_tokens, (input_tokens * nano_in + output_tokens * nano_out) / 1e9::DOUBLE AS cost_usd FROM summed LEFT JOIN pricing USING (vendor, model)""", "workloads", "pricing")
def summarize_workloads(spark, sf_dir):
    return op.summarize_workloads(receipts.table(spark, sf_dir, "workloads"), dims.table(spark, "pricing"))


@query("expand_workloads", """WITH each AS (SELECT *, unnest(range(requests)) AS i FROM workloads WHERE requests > 0)
SELECT l_orderkey, l_linenumber, raw_model, app, i, ((i + 1) * input_total) // requests - (i * input_total) // requests AS input_tokens, ((i + 1) * output_total) // requests - (i * output_total) // requests AS output_tokens FROM each""", "workloads")
def expand_workloads(spark, sf_dir):
    return op.expand_workloads(receipts.table(spark, sf_dir, "workloads"), "l_orderkey", "l_linenumber")


@query("carbon_of", """SELECT receipt_id, floor((input_tokens + output_tokens) * deci_wh_1k / 1e4::DOUBLE * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS wh,
  floor((input_tokens + output_tokens) * deci_wh_1k * grid_g / 1e7::DOUBLE * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS g_co2e FROM receipts LEFT JOIN energy USING (vendor, model)""", "receipts", "energy")
def carbon_of(spark, sf_dir):
    return op.carbon_of(receipts.core(spark, sf_dir), dims.table(spark, "energy")).select("receipt_id", "wh", "g_co2e")


@query("carbon_rollup", """SELECT vendor, floor(CAST(sum((input_tokens + output_tokens) * deci_wh_1k) AS BIGINT) / 1e4::DOUBLE * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS wh,
  floor(CAST(sum((input_tokens + output_tokens) * deci_wh_1k * grid_g) AS BIGINT) / 1e7::DOUBLE * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS g_co2e FROM receipts JOIN energy USING (vendor, model) GROUP BY ROLLUP (vendor)""", "receipts", "energy")
def carbon_rollup(spark, sf_dir):
    return op.carbon_rollup(receipts.core(spark, sf_dir), dims.table(spark, "energy"))


_PAIRS = """WITH pairs AS (SELECT run_id, intent, approved, at_iso, planner_in * p.nano_in + planner_out * p.nano_out + coalesce(executor_in, 0) * e.nano_in + coalesce(executor_out, 0) * e.nano_out AS cost_nano,
  (planner_in + coalesce(executor_in, 0)) * e.nano_in + (planner_out + coalesce(executor_out, 0)) * e.nano_out AS base_nano
  FROM cascade_runs JOIN intents USING (intent) JOIN pricing p ON p.vendor = planner_vendor AND p.model = planner_model JOIN pricing e ON e.vendor = executor_vendor AND e.model = executor_model) """


def pairs(spark, sf_dir):
    return op.cascade_pairs(receipts.table(spark, sf_dir, "cascade_runs"), dims.table(spark, "intents"), dims.table(spark, "pricing"))


@query("cascade_pairs", _PAIRS + "SELECT run_id, intent, cost_nano / 1e9::DOUBLE AS cost_usd, (base_nano - cost_nano) / 1e9::DOUBLE AS savings_usd FROM pairs", "cascade_runs", "intents", "pricing")
def cascade_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("run_id", "intent", op.usd(F.col("cost_nano")).alias("cost_usd"), op.usd(F.col("base_nano") - F.col("cost_nano")).alias("savings_usd"))


@query("savings_rollup", _PAIRS + """, summed AS (SELECT intent, count(*) AS runs, CAST(sum(cost_nano) AS BIGINT) AS c, CAST(sum(base_nano) AS BIGINT) AS b FROM pairs WHERE at_iso >= '1997-01-01T00:00:00Z' GROUP BY ROLLUP (intent))
SELECT intent, runs, c / 1e9::DOUBLE AS spent_usd, b / 1e9::DOUBLE AS baseline_usd, (b - c) / 1e9::DOUBLE AS savings_usd, CASE WHEN b = 0 THEN 0 ELSE floor((b - c) / b::DOUBLE * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE END AS savings_share,
  (b - c) / 1e9::DOUBLE / runs AS per_run_usd FROM summed""", "cascade_runs", "intents", "pricing")
def savings_rollup(spark, sf_dir):
    return op.savings_rollup(pairs(spark, sf_dir), "1997-01-01T00:00:00Z")


_SAMPLES = _PRICED + """, samples AS (SELECT *, event_id % 41 = 0 AS cache_hit, CASE WHEN event_id % 2 = 0 AND event_id % 9 < 6 THEN event_id % 12 <> 0 END AS cascade_approved FROM priced) """


@query("recommend", _SAMPLES + """, s AS (SELECT use_case_id, vendor, model, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(sum(nano) AS BIGINT) AS nano, count(cascade_approved) AS runs,
  count(*) FILTER (cascade_approved) AS accepted, count(*) FILTER (cache_hit) AS hits FROM samples WHERE nano IS NOT NULL GROUP BY ALL),
j AS (SELECT s.*, t.cheaper, i * a.nano_in + o * a.nano_out AS alt FROM s LEFT JOIN (SELECT * FROM tiers WHERE premium) t ON t.vendor = s.vendor AND t.model = s.model LEFT JOIN pricing a ON a.vendor = s.vendor AND a.model = t.cheaper WHERE nano > 0)
SELECT 'use_cheaper_model' AS kind, use_case_id, vendor || ':' || model AS from_model, vendor || ':' || cheaper AS to_model, floor((nano - alt) * 1.0::DOUBLE / 1e9::DOUBLE * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS monthly_usd FROM j WHERE alt IS NOT NULL AND runs >= 20 AND 10 * accepted >= 8 * runs
UNION ALL SELECT 'enable_cascade', use_case_id, vendor || ':' || model, vendor || ':' || cheaper, floor((0.5::DOUBLE * nano - alt) * 1.0::DOUBLE / 1e9::DOUBLE * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE FROM j WHERE alt IS NOT NULL AND runs = 0 AND n >= 50 AND 0.5::DOUBLE * nano - alt > 0
UNION ALL SELECT 'enable_dedup_cache', use_case_id, vendor || ':' || model, NULL, 0::DOUBLE FROM j WHERE n >= 100 AND 100 * hits < 5 * n""", "receipts", "pricing", "tiers")
def recommend(spark, sf_dir):
    id_ = F.col("event_id")
    rows = priced(spark, sf_dir).withColumn("cache_hit", id_ % 41 == 0).withColumn("cascade_approved", F.when((id_ % 2 == 0) & (id_ % 9 < 6), id_ % 12 != 0))
    return op.recommend(rows, dims.table(spark, "tiers"), dims.table(spark, "pricing"))


@query("choose_cascade", """SELECT run_id, CASE WHEN risk = 'high' OR estimated_input_tokens < 200 THEN executor_vendor || ':' || executor_model ELSE planner_vendor || ':' || planner_model END AS planner, executor_vendor || ':' || executor_model AS executor,
  CASE WHEN risk = 'high' THEN 'high risk' WHEN estimated_input_tokens < 200 THEN 'small input' ELSE 'cascade' END AS reason FROM cascade_runs JOIN intents USING (intent)""", "cascade_runs", "intents")
def choose_cascade(spark, sf_dir):
    return op.choose_cascade(receipts.table(spark, sf_dir, "cascade_runs"), dims.table(spark, "intents"))


@query("fit_score", """WITH scored AS (SELECT run_id, cheap_model, greatest(0, least(100, base_score - CASE WHEN planner_in > 2000 THEN 10 ELSE 0 END - CASE WHEN risk = 'medium' THEN 15 ELSE 0 END
  + CASE WHEN ceil(planner_out * 8 / 4.0) < 400 THEN 5 ELSE 0 END - CASE WHEN ceil(planner_out * 8 / 4.0) > 4000 THEN 10 ELSE 0 END)) AS points FROM cascade_runs JOIN intents USING (intent))
SELECT run_id, points / 100.0::DOUBLE AS score, CASE WHEN points >= 65 THEN cheap_model END AS recommended_model FROM scored""", "cascade_runs", "intents")
def fit_score(spark, sf_dir):
    runs = receipts.table(spark, sf_dir, "cascade_runs")
    return op.fit_score(runs.select("run_id", "intent", F.col("planner_in").alias("expected_output"), (F.col("risk") == "medium").alias("has_tools"), (F.col("planner_out") * 8).alias("prompt_chars")), dims.table(spark, "intents"))


def _round(x: str, digits: int = 2) -> str:
    return f"floor(({x}) * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE"


_PERIODS = _NORMAL + f""", q AS (SELECT at_iso < '1998-07-01' AS old, CAST(sum(input_total) AS BIGINT) AS i, CAST(sum(output_total) AS BIGINT) AS o, CAST(sum(input_total * nano_in) AS BIGINT) AS ci, CAST(sum(output_total * nano_out) AS BIGINT) AS co
  FROM normal JOIN pricing USING (vendor, model) WHERE requests > 0 GROUP BY 1),
p AS (SELECT *, {_round('(ci + co) / 1e9::DOUBLE')} AS total_usd, {_round('ci / 1e9::DOUBLE')} AS input_usd, {_round('ci / CAST(i AS DOUBLE) / 1e9::DOUBLE', 12)} AS input_rate, {_round('co / CAST(o AS DOUBLE) / 1e9::DOUBLE', 12)} AS output_rate FROM q),
f AS (SELECT b.total_usd AS baseline_usd, c.total_usd AS actual_usd, {_round('(c.i * (b.ci / CAST(b.i AS DOUBLE)) + c.o * (b.co / CAST(b.o AS DOUBLE))) / 1e9::DOUBLE')} AS counterfactual_usd, b.input_rate, b.output_rate, {_round('c.i * (b.ci / CAST(b.i AS DOUBLE)) / 1e9::DOUBLE')} AS input_counterfactual_usd, {_round('b.total_usd - c.total_usd')} AS delta_usd,
  sha256('{{"input_nano":' || b.ci || ',"input_tokens":' || b.i || ',"output_nano":' || b.co || ',"output_tokens":' || b.o || '}}') AS baseline_sha256 FROM p b, p c WHERE b.old AND NOT c.old),
h AS (SELECT *, {_round('counterfactual_usd - actual_usd')} AS saving_usd FROM f), g AS (SELECT *, {_round('saving_usd / counterfactual_usd', 4)} AS saving_share FROM h) """


def periods(spark, sf_dir):
    rows, pricing = receipts.table(spark, sf_dir, "workloads"), dims.table(spark, "pricing")
    return [op.period_summary(op.summarize_workloads(rows.where(w), pricing).drop("cost_usd"), pricing) for w in ("at_iso < '1998-07-01'", "at_iso >= '1998-07-01'")]


@query("period_summary", _PERIODS + f"SELECT i AS input_tokens, o AS output_tokens, ci AS input_nano, co AS output_nano, total_usd, input_usd, {_round('total_usd - input_usd')} AS output_usd, input_rate, output_rate FROM p", "workloads", "pricing")
def period_summary(spark, sf_dir):
    baseline, current = periods(spark, sf_dir)
    return baseline.unionByName(current)


@query("prove_savings", _PERIODS + "SELECT * FROM g", "workloads", "pricing")
def prove_savings(spark, sf_dir):
    return op.prove_savings(*periods(spark, sf_dir))


_FIGURES = ["baseline_usd", "actual_usd", "counterfactual_usd", "input_rate", "output_rate", "input_counterfactual_usd", "delta_usd", "saving_usd", "saving_share"]


@query("verify_savings", _PERIODS + "SELECT '' AS damaged, '' AS failed, true AS valid FROM g UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', '{c}', false FROM g" for c in [*_FIGURES, "baseline_sha256"]), "workloads", "pricing")
def verify_savings(spark, sf_dir):
    """The proof as it is, and once with each figure and the hash changed."""
    baseline, current = periods(spark, sf_dir)
    proof = op.prove_savings(baseline, current)
    stated = proof.withColumn("damaged", F.lit(""))
    for c in _FIGURES:
        stated = stated.unionByName(proof.withColumn("damaged", F.lit(c)).withColumn(c, F.col(c) + 0.01))
    stated = stated.unionByName(proof.withColumn("damaged", F.lit("baseline_sha256")).withColumn("baseline_sha256", F.sha2("baseline_sha256", 256)))
    return op.verify_savings(stated, baseline, current).select("damaged", "failed", "valid")


@query("top_receipts", _PRICED + "SELECT receipt_id, captured_at, nano / 1e9::DOUBLE AS cost_usd FROM priced WHERE nano IS NOT NULL ORDER BY nano DESC, captured_at DESC, receipt_id LIMIT 20", "receipts", "pricing")
def top_receipts(spark, sf_dir):
    return op.top_receipts(priced(spark, sf_dir))


@query("alert_cost_spike", _PRICED + """, dear AS (SELECT captured_day, nano * CASE WHEN captured_day = DATE '2024-01-20' THEN 5 ELSE 1 END AS nano FROM priced), days AS (SELECT captured_day, CAST(coalesce(sum(nano), 0) AS BIGINT) AS nano FROM dear GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY nano, captured_day) AS r, count(*) OVER () AS n FROM days), m AS (SELECT nano AS median FROM r WHERE n >= 3 AND r = n // 2 + 1)
SELECT captured_day, nano / 1e9::DOUBLE AS cost_usd, median / 1e9::DOUBLE AS median_usd FROM days, m WHERE nano > 3 * median AND nano > 10000000 AND median > 0 ORDER BY 1 LIMIT 1""", "receipts", "pricing")
def alert_cost_spike(spark, sf_dir):
    """Over all receipts, with one day's prices five times as high."""
    rows = priced(spark, sf_dir)
    return op.cost_spike(rows.withColumn("nano", F.col("nano") * F.when(F.col("captured_day") == F.lit("2024-01-20").cast("date"), 5).otherwise(1)))


_GUARD = _PRICED + """, spent AS (SELECT receipt_id, tenant_id, CAST(sum(coalesce(nano, 0)) OVER (PARTITION BY tenant_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM priced),
guarded AS (SELECT receipt_id, tenant_id, s / 1e9::DOUBLE AS spent_usd, greatest(0, 20000000000 - s) / 1e9::DOUBLE AS remaining_usd,
  CASE WHEN s >= 20000000000 THEN 'deny' WHEN 100 * s >= 90 * 20000000000 THEN 'throttle' WHEN 100 * s >= 75 * 20000000000 THEN 'warn' ELSE 'allow' END AS action FROM spent) """


@query("budget_guard", _GUARD + "SELECT * FROM guarded", "receipts", "pricing")
def budget_guard(spark, sf_dir):
    return op.budget_guard(priced(spark, sf_dir), 20_000_000_000).drop("ts")


@query("budget_events", _GUARD + """SELECT 'bg-' || receipt_id AS event_id, tenant_id, CASE WHEN action = 'deny' THEN 'ai.invocation_denied_by_budget' ELSE 'ai.invocation_budget_warning' END AS event_type, 'budget-guard' AS source_system, action, remaining_usd
  FROM guarded WHERE action <> 'allow'""", "receipts", "pricing")
def budget_events(spark, sf_dir):
    return op.budget_events(op.budget_guard(priced(spark, sf_dir), 20_000_000_000))
