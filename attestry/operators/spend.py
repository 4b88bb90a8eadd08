"""Usage, cost, carbon and savings over receipts and bills.

Costs are integer nano-dollars until the last step, so sums don't depend on order. Dimensions are looked up (`lookup`: broadcast
below a counted size, else joined with hot keys split); each job shuffles integer partial sums of its group keys only. Null vendors and models have no price: their cost is null in
benchmarks and 0 with a caveat in reports, as stated by each function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.columns import CLASSES, cost_nano, half_up, share, usd
from attestry.functions.tables import lookup


def price_usage(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """usage (vendor, model, input_tokens, output_tokens and, where it has them, cache_read_tokens, cache_write_tokens) with nano: the cost of all classes, null for a model without a price."""
    own = [c for c in CLASSES if c in usage.columns]
    return lookup(usage, pricing, ["vendor", "model"]).withColumn("nano", cost_nano(*own)).drop("nano_in", "nano_out", "nano_read", "nano_write")


def cost_by_class(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """vendor, model, class, tokens, cost_usd (null without a price) of each token class that usage has. Tokens are summed first, so each sum is priced once."""
    own = [c for c in CLASSES if c in usage.columns]
    summed = usage.where("model is not null").groupBy("vendor", "model").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in own])
    each = F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_tokens")).alias("class"), F.col(c).alias("tokens"), cost_nano(c).alias("nano")) for c in own]))
    return lookup(summed, pricing, ["vendor", "model"]).select("vendor", "model", each.alias("x")).select("vendor", "model", "x.class", "x.tokens", usd(F.col("x.nano")).alias("cost_usd"))


# Tier names in the order in which they are tried, with the vendor and model they stand for.
TIER_NAMES = [
    ("gpt-5-nano", "openai", "gpt-5-nano"),
    ("gpt-5-mini", "openai", "gpt-5-mini"),
    ("gpt-5", "openai", "gpt-5"),
    ("gpt-4o-mini", "openai", "gpt-4o-mini"),
    ("gpt-4o", "openai", "gpt-4o"),
    ("opus", "anthropic", "claude-opus-4-6"),
    ("sonnet", "anthropic", "claude-sonnet-4-6"),
    ("haiku", "anthropic", "claude-haiku-4-5"),
    ("gemini flash", "google", "gemini-2-5-flash"),
    ("gemini pro", "google", "gemini-2-5-pro"),
    ("gemini", "google", "gemini-2-5-pro"),
]


def normalize_model(raw: Column) -> tuple[Column, Column]:
    """vendor and model of a provider's model id: only digits and . _ - may follow the first tier name found."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    vendor = model = None
    for name, v, m in TIER_NAMES:
        family, _, tier = name.partition(" ")
        at = F.instr(s, family)
        rest = F.substring(s, at + len(family), F.length(s))
        if tier:
            second = F.instr(rest, tier)
            hit = (at > 0) & (second > 0) & F.substring(rest, second + len(tier), F.length(rest)).rlike(r"^[0-9._-]*$")
        else:
            hit = (at > 0) & rest.rlike(r"^[0-9._-]*$")
        vendor = F.when(hit, F.lit(v)) if vendor is None else vendor.when(hit, F.lit(v))
        model = F.when(hit, F.lit(m)) if model is None else model.when(hit, F.lit(m))
    other = F.regexp_replace(s, r"[^a-z0-9._-]", "")
    return vendor.otherwise(F.lit("unknown")), model.otherwise(F.when(other == "", F.lit("unknown")).otherwise(other))


def vendor_for_model(model: Column) -> Column:
    """The vendor of a routed model name by prefix or part; the first rule wins."""
    m = F.lower(F.coalesce(model, F.lit("")))
    has = lambda x: F.contains(m, F.lit(x))
    return (
        F.when(m.startswith("claude") | has("anthropic"), "anthropic")
        .when(m.startswith("gpt") | m.startswith("o") | has("openai"), "openai")
        .when(has("gemini") | has("vertex") | has("google"), "google")
        .when(has("bedrock"), "aws-bedrock")
        .when(has("azure"), "azure-openai")
        .otherwise("unknown")
    )


def filter_receipts(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that meet all conditions: model, app, event_type (parts, any case); vendor, decision, environment (equal);
    since, until (string order of captured_at); min_cost, max_cost (nano); min_tokens; sensitive, has_evidence, signed; text."""
    checks = {
        "model": lambda v: F.contains(F.lower("model"), F.lit(v.lower())),
        "app": lambda v: F.contains(F.lower("app"), F.lit(v.lower())),
        "event_type": lambda v: F.contains(F.lower("event_type"), F.lit(v.lower())),
        "vendor": lambda v: F.lower("vendor") == v.lower(),
        "decision": lambda v: F.col("decision") == v,
        "environment": lambda v: F.lower("environment") == v.lower(),
        "since": lambda v: F.col("captured_at") >= v,
        "until": lambda v: F.col("captured_at") <= v,
        "min_cost": lambda v: F.coalesce("nano", F.lit(0)) >= v,
        "max_cost": lambda v: F.coalesce("nano", F.lit(0)) <= v,
        "min_tokens": lambda v: F.col("input_tokens") + F.col("output_tokens") >= v,
        "sensitive": lambda v: (F.coalesce(F.col("input_class").isin("pii", "pci", "mnpi"), F.lit(False)) | F.coalesce(F.col("output_class").isin("pii", "pci", "mnpi"), F.lit(False))) == F.lit(v),
        "has_evidence": lambda v: (F.col("evidence_refs") > 0) == F.lit(v),
        "signed": lambda v: F.col("signed") == F.lit(v),
        "text": lambda v: F.contains(F.lower(F.concat_ws(" ", "receipt_id", "app", "model", "event_type", "decision")), F.lit(v.lower())),
    }
    return reduce(lambda df, kv: df.where(checks[kv[0]](kv[1])), wanted.items(), rows)


def query_receipts(rows: DataFrame, group_by: str, metric: str = "cost", limit: int = 10) -> DataFrame:
    """key, count, tokens, cost_usd of the `limit` greatest groups by the metric; ties by key. Unpriced rows cost 0."""
    summed = rows.groupBy(F.coalesce(F.col(group_by).cast("string"), F.lit("unknown")).alias("key")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.coalesce(F.sum("nano"), F.lit(0)).alias("nano")
    )
    by = {"count": "count", "cost": "nano", "tokens": "tokens"}[metric]
    return summed.orderBy(F.desc(by), "key").limit(limit).select("key", "count", "tokens", usd(F.col("nano")).alias("cost_usd"))


def query_totals(rows: DataFrame, cited: int = 20) -> DataFrame:
    """One row for the rows that a query matches: matched, tokens, cost_usd, unpriced and its models, and the first `cited` ids."""
    bare = F.col("nano").isNull() & F.col("model").isNotNull()
    totals = rows.agg(
        F.count(F.lit(1)).alias("matched"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"),
        usd(F.coalesce(F.sum("nano"), F.lit(0))).alias("cost_usd"),
        F.count_if(bare).alias("unpriced"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(bare, F.concat_ws(":", "vendor", "model"))))).alias("unpriced_models"),
    )
    ids = rows.select("receipt_id").orderBy("receipt_id").limit(cited).agg(F.concat_ws(",", F.sort_array(F.collect_list("receipt_id"))).alias("citations"))
    return totals.join(ids)


def query_list(rows: DataFrame, limit: int = 10) -> DataFrame:
    """receipt_id, captured_at, model, cost_usd of the newest `limit` rows; ties by id. Unpriced rows cost 0."""
    found = rows.orderBy(F.desc("captured_at"), "receipt_id").limit(limit)
    return found.select("receipt_id", "captured_at", "model", usd(F.coalesce("nano", F.lit(0))).alias("cost_usd"))


def unpriced_models(rows: DataFrame) -> DataFrame:
    """One row: how many receipts with a model have no price, and those models in order."""
    bare = F.col("nano").isNull() & F.col("model").isNotNull()
    return rows.agg(F.count_if(bare).alias("unpriced"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(bare, F.concat_ws(":", "vendor", "model"))))).alias("models"))


def summarize_totals(rows: DataFrame) -> DataFrame:
    """One row of totals; requests are rows with a model."""
    asked = F.col("model").isNotNull()
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return rows.agg(
        F.count(F.lit(1)).alias("receipts"),
        F.count_if(asked).alias("requests"),
        F.coalesce(F.sum(F.when(asked, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(asked, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        usd(F.coalesce(F.sum("nano"), F.lit(0))).alias("cost_usd"),
        F.count_if(asked & F.col("nano").isNotNull()).alias("priced_requests"),
        F.count_if(asked & F.col("nano").isNull()).alias("unpriced_requests"),
        F.coalesce(F.sum(F.when(F.col("nano").isNotNull(), tokens)), F.lit(0)).alias("priced_tokens"),
        F.count_if("signed").alias("signed"),
        F.max("chain_height").alias("max_chain_height"),
        F.count_if(F.col("evidence_refs") > 0).alias("with_evidence"),
        F.min("captured_at").alias("period_start"),
        F.max("captured_at").alias("period_end"),
    )


def summarize_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Requests, tokens, cost and whether all are priced, by keys; rows without a model are no requests."""
    return (
        rows.where("model is not null")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            usd(F.coalesce(F.sum("nano"), F.lit(0))).alias("cost_usd"),
            F.count_if(F.col("nano").isNull()).alias("unpriced_requests"),
        )
    )


def over_tiering(rows: DataFrame, tiers: DataFrame, pricing: DataFrame, least_calls: int = 3, light_output: int = 800, high_input: int = 4000) -> DataFrame:
    """(vendor, model, app) groups of premium calls with light output, and what the next cheaper model would have cost.

    Decision-bearing receipts don't count. confidence is high where the average input is at most `high_input` tokens.
    """
    light = lookup(rows.where("decision is null and model is not null"), tiers.where("premium"), ["vendor", "model"], "inner")
    summed = light.groupBy("vendor", "model", "app", "cheaper").agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("nano").alias("nano"))
    alt = pricing.select("vendor", F.col("model").alias("cheaper"), "nano_in", "nano_out")
    met = lookup(summed.where((F.col("requests") >= least_calls) & (F.col("output_tokens") <= light_output * F.col("requests"))), alt, ["vendor", "cheaper"], "inner")
    met = met.withColumn("alt_nano", cost_nano()).where("alt_nano < nano")
    return met.select(
        "vendor",
        "model",
        "app",
        "cheaper",
        "requests",
        usd(F.col("nano")).alias("cost_usd"),
        usd(F.col("nano") - F.col("alt_nano")).alias("savings_usd"),
        F.when(F.col("input_tokens") <= high_input * F.col("requests"), "high").otherwise("review").alias("confidence"),
    )


def summarize_workloads(bill: DataFrame, pricing: DataFrame) -> DataFrame:
    """Totals of bill rows (raw_model, app, requests, input_total, output_total) by vendor and model, weighted by requests."""
    vendor, model = normalize_model(F.col("raw_model"))
    rows = bill.where("requests > 0").select(vendor.alias("vendor"), model.alias("model"), "app", "requests", F.col("input_total").alias("input_tokens"), F.col("output_total").alias("output_tokens"))
    summed = rows.groupBy("vendor", "model").agg(*[F.sum(x).alias(x) for x in ("requests", "input_tokens", "output_tokens")])
    priced = price_usage(summed, pricing)
    return priced.select("vendor", "model", "requests", "input_tokens", "output_tokens", usd(F.col("nano")).alias("cost_usd"))


def expand_workloads(bill: DataFrame, *keys: str) -> DataFrame:
    """One row a request with an exact whole split: floor((i+1) t / n) - floor(i t / n). For small bills."""
    each = bill.where("requests > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("requests") - 1)))
    split = lambda t: F.expr(f"(i + 1) * {t} div requests - i * {t} div requests")
    return each.select(*keys, "raw_model", "app", "i", split("input_total").alias("input_tokens"), split("output_total").alias("output_tokens"))


def carbon_of(rows: DataFrame, energy: DataFrame) -> DataFrame:
    """rows with wh and g_co2e, 4 digits; null for a model without a profile."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    joined = lookup(rows, energy, ["vendor", "model"])
    return joined.withColumn("wh", half_up(tokens * F.col("deci_wh_1k") / 1e4, 4)).withColumn("g_co2e", half_up(tokens * F.col("deci_wh_1k") * F.col("grid_g") / 1e7, 4)).drop("deci_wh_1k", "grid_g")


def carbon_rollup(rows: DataFrame, energy: DataFrame) -> DataFrame:
    """vendor (null: total), wh, g_co2e: exact sums rounded once."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    joined = lookup(rows, energy, ["vendor", "model"], "inner")
    summed = joined.rollup("vendor").agg(F.sum(tokens * F.col("deci_wh_1k")).alias("w"), F.sum(tokens * F.col("deci_wh_1k") * F.col("grid_g")).alias("g"))
    return summed.select("vendor", half_up(F.coalesce("w", F.lit(0)) / 1e4, 4).alias("wh"), half_up(F.coalesce("g", F.lit(0)) / 1e7, 4).alias("g_co2e"))


def cascade_pairs(runs: DataFrame, intents: DataFrame, pricing: DataFrame) -> DataFrame:
    """Each planner-executor run: its cost, all its tokens at the executor's price, and the saving, which may be negative."""
    plan = pricing.select(F.col("vendor").alias("planner_vendor"), F.col("model").alias("planner_model"), F.col("nano_in").alias("p_in"), F.col("nano_out").alias("p_out"))
    execute = pricing.select(F.col("vendor").alias("executor_vendor"), F.col("model").alias("executor_model"), F.col("nano_in").alias("e_in"), F.col("nano_out").alias("e_out"))
    joined = lookup(runs, intents, ["intent"], "inner")
    joined = lookup(lookup(joined, plan, ["planner_vendor", "planner_model"], "inner"), execute, ["executor_vendor", "executor_model"], "inner")
    more_in, more_out = F.coalesce("executor_in", F.lit(0)), F.coalesce("executor_out", F.lit(0))
    cost = F.col("planner_in") * F.col("p_in") + F.col("planner_out") * F.col("p_out") + more_in * F.col("e_in") + more_out * F.col("e_out")
    base = (F.col("planner_in") + more_in) * F.col("e_in") + (F.col("planner_out") + more_out) * F.col("e_out")
    return joined.select("run_id", "intent", "approved", "at_iso", cost.alias("cost_nano"), base.alias("base_nano"))


def savings_rollup(pairs: DataFrame, since: str) -> DataFrame:
    """intent (null: total): runs, dollars spent and at baseline, saving, its share, average saving of a run."""
    summed = pairs.where(F.col("at_iso") >= since).rollup("intent").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("cost_nano"), F.lit(0)).alias("cost"), F.coalesce(F.sum("base_nano"), F.lit(0)).alias("base"))
    saved = F.col("base") - F.col("cost")
    return summed.select("intent", "runs", usd(F.col("cost")).alias("spent_usd"), usd(F.col("base")).alias("baseline_usd"), usd(saved).alias("savings_usd"), share(saved, F.col("base")).alias("savings_share"), F.when(F.col("runs") > 0, usd(saved) / F.col("runs")).otherwise(0.0).alias("per_run_usd"))


def recommend(rows: DataFrame, tiers: DataFrame, pricing: DataFrame, days: int = 30) -> DataFrame:
    """kind, use_case_id, from_model, to_model, monthly_usd for each (use case, vendor, model) that meets a rule.

    rows: use_case_id, vendor, model, tokens, nano, cache_hit, cascade_approved (null: no cascade run).
    """
    summed = rows.where("nano is not null").groupBy("use_case_id", "vendor", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("nano").alias("nano"),
        F.count("cascade_approved").alias("runs"),
        F.count_if("cascade_approved").alias("accepted"),
        F.count_if("cache_hit").alias("hits"),
    )
    alt = pricing.select("vendor", F.col("model").alias("cheaper"), "nano_in", "nano_out")
    joined = lookup(lookup(summed.where("nano > 0"), tiers.where("premium"), ["vendor", "model"]), alt, ["vendor", "cheaper"]).withColumn("alt", cost_nano())
    month = 30 / max(1, days)
    cents = lambda nano: half_up(nano * month / 1e9, 2)
    name = F.concat_ws(":", "vendor", "model")
    to = F.concat_ws(":", "vendor", "cheaper")

    def told(kind: str, met: Column, target: Column, value: Column) -> DataFrame:
        return joined.where(met).select(F.lit(kind).alias("kind"), "use_case_id", name.alias("from_model"), target.alias("to_model"), value.alias("monthly_usd"))

    gain = 0.5 * F.col("nano") - F.col("alt")
    return (
        told("use_cheaper_model", F.col("alt").isNotNull() & (F.col("runs") >= 20) & (10 * F.col("accepted") >= 8 * F.col("runs")), to, cents(F.col("nano") - F.col("alt")))
        .unionByName(told("enable_cascade", F.col("alt").isNotNull() & (F.col("runs") == 0) & (F.col("n") >= 50) & (gain > 0), to, cents(gain)))
        .unionByName(told("enable_dedup_cache", (F.col("n") >= 100) & (100 * F.col("hits") < 5 * F.col("n")), F.lit(None).cast("string"), F.lit(0.0)))
    )


def choose_cascade(rules: DataFrame, intents: DataFrame) -> DataFrame:
    """Planner and executor for each rule (intent, risk, estimated_input_tokens); risky or small tasks skip the planner."""
    skip = (F.col("risk") == "high") | (F.col("estimated_input_tokens") < 200)
    joined = lookup(rules, intents, ["intent"], "inner")
    executor = F.concat_ws(":", "executor_vendor", "executor_model")
    reason = F.when(F.col("risk") == "high", "high risk").when(F.col("estimated_input_tokens") < 200, "small input").otherwise("cascade")
    return joined.select("run_id", F.when(skip, executor).otherwise(F.concat_ws(":", "planner_vendor", "planner_model")).alias("planner"), executor.alias("executor"), reason.alias("reason"))


def fit_score(prompts: DataFrame, intents: DataFrame) -> DataFrame:
    """run_id, score (hundredths / 100), recommended_model for (run_id, intent, expected_output, has_tools, prompt_chars)."""
    joined = lookup(prompts, intents, ["intent"], "inner")
    tokens = F.ceil(F.col("prompt_chars") / 4)
    points = F.col("base_score") - F.when(F.col("expected_output") > 2000, 10).otherwise(0) - F.when(F.col("has_tools"), 15).otherwise(0) + F.when(tokens < 400, 5).otherwise(0) - F.when(tokens > 4000, 10).otherwise(0)
    points = F.greatest(F.lit(0), F.least(F.lit(100), points))
    return joined.select("run_id", (points / 100.0).alias("score"), F.when(points >= 65, F.col("cheap_model")).alias("recommended_model"))


def period_summary(by_model: DataFrame, pricing: DataFrame) -> DataFrame:
    """Priced tokens, nano-dollars and dollars by class of one period, and each class's rate (dollars a token, 12 digits), as one row.

    by_model: vendor, model, input_tokens, output_tokens. Models without a price are left out. The output class takes what
    the rounded total leaves beside the rounded input class, so that the classes add up to it.
    """
    found = lookup(by_model, pricing, ["vendor", "model"], "inner").agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.col("input_tokens") * F.col("nano_in")), F.lit(0)).alias("input_nano"),
        F.coalesce(F.sum(F.col("output_tokens") * F.col("nano_out")), F.lit(0)).alias("output_nano"),
    )
    rate = lambda k: F.when(F.col(f"{k}_tokens") > 0, half_up(F.col(f"{k}_nano") / F.col(f"{k}_tokens") / 1e9, 12)).otherwise(0.0).alias(f"{k}_rate")
    priced = found.withColumn("total_usd", half_up((F.col("input_nano") + F.col("output_nano")) / 1e9, 2)).withColumn("input_usd", half_up(F.col("input_nano") / 1e9, 2))
    return priced.select("*", half_up(F.col("total_usd") - F.col("input_usd"), 2).alias("output_usd"), rate("input"), rate("output"))


def _baseline_hash() -> Column:
    """SHA-256 of the canonical JSON of a period's whole numbers (keys in order, no spaces): what a proof binds itself to."""
    names = ["input_nano", "input_tokens", "output_nano", "output_tokens"]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.col(f"b_{n}").cast("string")) for n in names]), F.lit("}")), 256)


def prove_savings(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row of nine figures and the baseline's hash: what the current volume would cost at the baseline's rates, less what it did cost.

    delta_usd is the plain difference of the two periods, which volume moves too.
    """
    joined = baseline.select(*[F.col(c).alias("b_" + c) for c in baseline.columns]).join(current)
    rate = lambda k: F.when(F.col(f"b_{k}_tokens") > 0, F.col(f"b_{k}_nano") / F.col(f"b_{k}_tokens")).otherwise(0.0)
    counterfactual = half_up((F.col("input_tokens") * rate("input") + F.col("output_tokens") * rate("output")) / 1e9, 2)
    first = joined.select(
        F.col("b_total_usd").alias("baseline_usd"),
        F.col("total_usd").alias("actual_usd"),
        counterfactual.alias("counterfactual_usd"),
        F.col("b_input_rate").alias("input_rate"),
        F.col("b_output_rate").alias("output_rate"),
        half_up(F.col("input_tokens") * rate("input") / 1e9, 2).alias("input_counterfactual_usd"),
        half_up(F.col("b_total_usd") - F.col("total_usd"), 2).alias("delta_usd"),
        _baseline_hash().alias("baseline_sha256"),
    )
    saved = first.withColumn("saving_usd", half_up(F.col("counterfactual_usd") - F.col("actual_usd"), 2))
    return saved.withColumn("saving_share", share(F.col("saving_usd"), F.col("counterfactual_usd")))


def verify_savings(stated: DataFrame, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """stated (the columns of prove_savings) with failed (the figures that aren't what the summaries give, in order) and valid.

    A figure that is missing or null fails.
    """
    own = prove_savings(baseline, current)
    missing = [c for c in own.columns if c not in stated.columns]
    told = stated.select("*", *[F.lit(None).alias(c) for c in missing])
    joined = told.join(own.select(*[F.col(c).alias("_" + c) for c in own.columns]))
    failed = F.concat_ws(",", *[F.when(~F.coalesce(F.col(c) == F.col("_" + c), F.lit(False)), c) for c in own.columns])
    return joined.withColumn("failed", failed).select(*stated.columns, "failed", (F.col("failed") == "").alias("valid"))


def top_receipts(rows: DataFrame, limit: int = 20) -> DataFrame:
    """The dearest receipts; newest first on ties, then by id."""
    return rows.where("nano is not null").orderBy(F.desc("nano"), F.desc("captured_at"), "receipt_id").limit(limit).select("receipt_id", "captured_at", usd(F.col("nano")).alias("cost_usd"))


def cost_spike(rows: DataFrame, times: int = 3) -> DataFrame:
    """The earliest day that cost more than `times` times the upper median day (and over a cent), of three days or more."""
    days = rows.groupBy("captured_day").agg(F.coalesce(F.sum("nano"), F.lit(0)).alias("nano"))
    ranked = days.withColumn("r", F.row_number().over(Window.orderBy("nano", "captured_day"))).withColumn("n", F.count(F.lit(1)).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    middle = ranked.where((F.col("n") >= 3) & (F.col("r") == F.floor(F.col("n") / 2) + 1)).select(F.col("nano").alias("median"))
    hit = days.join(F.broadcast(middle)).where((F.col("nano") > times * F.col("median")) & (F.col("nano") > 10_000_000) & (F.col("median") > 0))
    return hit.orderBy("captured_day").limit(1).select("captured_day", usd(F.col("nano")).alias("cost_usd"), usd(F.col("median")).alias("median_usd"))


def budget_guard(rows: DataFrame, limit_nano: int) -> DataFrame:
    """Each receipt with its tenant's spend of the month so far, itself included, and the action at this limit.

    Two steps keep a large tenant out of one task: days are summed and their totals run on, then each day runs by itself.
    """
    month = F.date_trunc("month", F.col("ts")).cast("date")
    priced = rows.select("receipt_id", "tenant_id", "event_id", "ts", "captured_day", month.alias("month"), F.coalesce("nano", F.lit(0)).alias("nano"))
    days = priced.groupBy("tenant_id", "month", "captured_day").agg(F.sum("nano").alias("day_nano"))
    before = Window.partitionBy("tenant_id", "month").orderBy("captured_day").rowsBetween(Window.unboundedPreceding, -1)
    bases = days.select("tenant_id", "captured_day", F.coalesce(F.sum("day_nano").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("tenant_id", "captured_day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = priced.withColumn("within", F.sum("nano").over(inside)).join(bases, ["tenant_id", "captured_day"]).withColumn("spent", F.col("base") + F.col("within"))
    action = F.when(F.col("spent") >= limit_nano, "deny").when(100 * F.col("spent") >= 90 * limit_nano, "throttle").when(100 * F.col("spent") >= 75 * limit_nano, "warn").otherwise("allow")
    left = F.greatest(F.lit(0), limit_nano - F.col("spent"))
    return spent.select("receipt_id", "tenant_id", "ts", usd(F.col("spent")).alias("spent_usd"), usd(left).alias("remaining_usd"), action.alias("action"))


def budget_events(guarded: DataFrame) -> DataFrame:
    """Event rows for the decisions of budget_guard other than allow."""
    kind = F.when(F.col("action") == "deny", "ai.invocation_denied_by_budget").otherwise("ai.invocation_budget_warning")
    return guarded.where("action <> 'allow'").select(F.concat(F.lit("bg-"), "receipt_id").alias("event_id"), "tenant_id", kind.alias("event_type"), F.lit("budget-guard").alias("source_system"), "action", "remaining_usd")
