"""Personal data, injection attempts, deviations, shadow AI and the combined verdict over texts.

Injection rules are built-in regular expressions in one pass. Personal data needs an overlap pass in text order, so it
runs in a vectorised helper; no text leaves its task, findings hold a redacted preview only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category and pattern of personal data, in the order in which they are tried.
PII = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("us_ssn", r"\b(?!000|9\d{2})\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d[ -]*?){13,19}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("uae_emirates_id", r"\b784-\d{4}-\d{7}-\d\b"),
    ("saudi_national_id", r"\b[12]\d{9}\b"),
    ("indian_aadhaar", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("phone", r"\+\d{1,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}\b"),
    ("ip_address", r"\b(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d?\d)){3}\b"),
    ("customer_id", r"\b(?:C|CUST|ACC|MEMB|CIF)[-_]\d{4,12}\b"),
    ("account_number", r"\b\d{10,18}\b"),
    ("wire_reference", r"\b(?:WIRE|TXN|REF|PMT|MT103)[-_]\d{4,}[-_A-Z0-9]+\b"),
    ("passport", r"\b[A-Z]{1,3}\d{6,9}\b"),
    ("date_of_birth", r"\b(?:19[2-9]\d|20[01]\d)-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"),
    ("api_key", r"\b(?:sk-(?:proj-)?[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{12,}|xox[bpars]-[A-Za-z0-9-]{10,})\b"),
]
# Category, severity and pattern of injection rules.
INJECTION = [
    ("instruction_override", "high", r"\b(?:ignore|disregard|forget|skip|override)\b(?:\s+\w+){0,4}\s+(?:previous|prior|earlier|preceding|original|above)\b(?:\s+\w+){0,3}\s+(?:instructions?|prompts?|rules?|directives?|guidelines?|messages?)\b"),
    ("instruction_override", "medium", r"\b(?:new|updated|revised)\s+instructions?\s*[:\-]"),
    ("role_injection", "high", r"\byou\s+are\s+(?:now\s+)?(?:a\s+different|another|an?\s+un?restricted|an?\s+evil|an?\s+jailbroken)\b"),
    ("role_injection", "high", r"\b(?:pretend|act|behave|roleplay)\s+(?:as\s+if\s+)?(?:like\s+)?(?:that\s+)?you\s+(?:are|were)\s+(?:not|no\s+longer)\b"),
    ("system_prompt_leak", "high", r"\b(?:show|reveal|print|display|repeat|give|tell|leak)\s+(?:me\s+)?(?:your|the)\s+(?:system|initial|original|base|hidden|secret)\s+(?:prompt|instructions?|message|rules?)\b"),
    ("system_prompt_leak", "medium", r"\bwhat\s+(?:are|were)\s+(?:your|the)\s+(?:original|initial|first|system)\s+(?:instructions?|prompts?)\b"),
    ("dan_jailbreak", "high", r"\b(?:DAN|STAN|DUDE|Developer\s+Mode|jailbreak\s+mode|do\s+anything\s+now)\b"),
    ("dan_jailbreak", "medium", r"\b(?:without\s+(?:any\s+)?(?:restrictions?|filters?|warnings?|disclaimers?|ethics?|morals?))\b"),
    ("delimiter_injection", "high", r"(?:</?(?:system|admin|root|assistant|user|instruction)>)|(?:\[/?(?:system|admin|root|assistant|user|instruction)\])|(?:#{3,}\s*(?:system|admin)\s*#{3,})"),
    ("encoded_payload", "medium", r"\b(?:base64|b64)\s*[:\-]?\s*[A-Za-z0-9+/=]{40,}"),
    ("encoded_payload", "high", r"\b(?:decode|decipher|deobfuscate|rot13)\s+(?:this|the\s+following|and\s+(?:execute|run))"),
    ("tool_override", "high", r"\b(?:call|invoke|execute|run)\s+(?:the\s+)?(?:function|tool|api|endpoint)\s+(?:with\s+)?(?:admin|root|sudo|unrestricted)\s+(?:privileges?|access)\b"),
    ("policy_bypass", "high", r"\b(?:bypass|circumvent|get\s+around|work\s+around)\s+(?:the\s+)?(?:policy|policies|safety|filter|guard|guardrail|restriction)"),
    ("policy_bypass", "low", r"\bthis\s+is\s+(?:just\s+)?(?:for|a)\s+(?:research|educational|hypothetical|fictional)\s+purposes?\s+only\b"),
]
#: Words of which a text that meets the rule at the same place holds one, in lower case: they are sought before the rule is tried.
ANCHORS = [
    ["ignore", "disregard", "forget", "skip", "override"],
    ["instruction"],
    ["different", "another", "restricted", "evil", "jailbroken"],
    ["pretend", "act", "behave", "roleplay"],
    ["prompt", "instruction", "message", "rule"],
    ["prompt", "instruction"],
    ["dan", "stan", "dude", "developer", "jailbreak", "anything"],
    ["without"],
    ["system", "admin", "root", "assistant", "user", "instruction"],
    ["base64", "b64"],
    ["decode", "decipher", "deobfuscate", "rot13"],
    ["privilege", "access"],
    ["bypass", "circumvent", "around"],
    ["purpose"],
]
# Hosts of consumer services.
CONSUMER = ["chat.openai.com", "chatgpt.com", "claude.ai", "gemini.google.com", "perplexity.ai", "you.com", "copilot.microsoft.com"]


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def iban(text: str) -> bool:
    if not 15 <= len(text) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


_CHECKS = {"credit_card": luhn, "iban": iban}
_COMPILED = [(c, re.compile(p, re.ASCII)) for c, p in PII]


def findings(text: str | None) -> list[tuple[str, int, int, float]]:
    """(category, start, end, confidence) in text order; of overlapping ones the surer stays, then the longer."""
    found = []
    for category, pattern in _COMPILED:
        check = _CHECKS.get(category)
        for m in pattern.finditer(text or ""):
            if check is None or check(m[0]):
                found.append((category, m.start(), m.end(), 0.7 if check is None else 0.95))
    kept: list[tuple[str, int, int, float]] = []
    for f in sorted(found, key=lambda f: f[1]):
        if not kept or f[1] >= kept[-1][2]:
            kept.append(f)
        elif (f[3], f[2] - f[1]) > (kept[-1][3], kept[-1][2] - kept[-1][1]):
            kept[-1] = f
    return kept


def redacted(text: str) -> str:
    return "•" * len(text) if len(text) <= 6 else f"{text[:4]}…{text[-2:]}"


#: Every finding has a digit, an @ or the beginning of a key: other texts don't leave the JVM.
HINT = r"[0-9@]|sk-|ghp_|AKIA|xox[bpars]-"
FOUND = "category string, start int, end int, confidence double, preview string"


def scan_pii(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, category, start, end (code points), confidence, preview for each finding in rows."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, c, s, e, p, redacted(t[s:e])) for k, t in zip(b[key], b[text], strict=True) for c, s, e, p in findings(t)]
            yield pd.DataFrame(out, columns=[key, "category", "start", "end", "confidence", "preview"])

    return rows.where(F.col(text).rlike(HINT)).select(key, text).mapInPandas(run, f"`{key}` {kind}, {FOUND}")


class _Findings:
    def eval(self, text: str):
        for category, start, end, confidence in findings(text):
            yield category, start, end, confidence, redacted(text[start:end])


def register_findings(spark: SparkSession, name: str = "pii_findings") -> str:
    """Registers the table function name(text) with the columns of scan_pii but the key, for `FROM t, LATERAL name(text)`. Null texts give no rows."""
    spark.udtf.register(name, F.udtf(_Findings, returnType=FOUND, useArrow=True))
    return name


def pii_counts(found: DataFrame, key: str) -> DataFrame:
    """key, category, findings, sure from the rows of scan_pii."""
    return found.groupBy(key, "category").agg(F.count(F.lit(1)).alias("findings"), F.bool_or(F.col("confidence") >= 0.9).alias("sure"))


def redact_pii(text: Column, categories: tuple[str, ...] = ("email", "api_key", "customer_id", "ip_address", "us_ssn")) -> Column:
    """Text with findings of the plain categories replaced by [category], before it is hashed. ASCII word bounds."""
    for category, pattern in PII:
        if category in categories:
            text = F.regexp_replace(text, pattern, f"[{category}]")
    return text


def covered(text: str | None) -> str | None:
    """The text with every finding of the fifteen categories replaced by [category]."""
    if text is None:
        return None
    out, at = [], 0
    for category, start, end, _ in findings(text):
        out += [text[at:start], f"[{category}]"]
        at = end
    return "".join(out) + text[at:]


def redact_all(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and text for each row, with all findings replaced, those with a checksum too: what is hashed or kept holds none of them."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], text: [covered(t) for t in b[text]]})

    slim = rows.select(key, text)
    clean = slim.where(~F.coalesce(F.col(text).rlike(HINT), F.lit(False)))
    return slim.where(F.col(text).rlike(HINT)).mapInPandas(run, f"`{key}` {kind}, `{text}` string").unionByName(clean)


def with_pii(rows: DataFrame, key: str, **texts: str) -> DataFrame:
    """rows with, for each name=column of texts, name_pii (a category for each finding, in text order) and name_sure (one of them is sure)."""
    for name, column in texts.items():
        found = scan_pii(rows, key, column).groupBy(key).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("start", "category"))), lambda x: x["category"]).alias(f"{name}_pii"), F.bool_or(F.col("confidence") >= 0.9).alias(f"{name}_sure")
        )
        rows = rows.join(found, key, "left").withColumn(f"{name}_pii", F.coalesce(f"{name}_pii", F.array().cast("array<string>"))).withColumn(f"{name}_sure", F.coalesce(f"{name}_sure", F.lit(False)))
    return rows


def scan_injection(text: Column) -> Column:
    """struct(points, hits, codes): hundredths of the score (at most 100) and a reason code for each rule met.

    The lower-case text and the rules that are met are each made once, as the one element of an array; a rule's pattern is
    tried only where the text holds one of its anchors.
    """
    weight = {"low": 15, "medium": 40, "high": 70}
    once = lambda x, of: F.get(F.transform(F.array(x), of), F.lit(0))
    hit = lambda c, w: F.struct(F.lit(f"injection:{c}").alias("code"), F.lit(w).alias("w"))

    def met(low: Column) -> Column:
        rules = [F.when((F.length(text) > 4000) & text.rlike(r"(?i)</?(?:system|admin|instruction)>"), hit("context_overflow", 40))]
        for (c, s, p), anchors in zip(INJECTION, ANCHORS, strict=True):
            held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in anchors])
            rules.append(F.when(held & text.rlike("(?i)" + p), hit(c, weight[s])))
        return F.filter(F.array(*rules), lambda x: x.isNotNull())

    def told(m: Column) -> Column:
        points = F.least(F.lit(100), F.aggregate(m, F.lit(0), lambda a, x: a + x["w"]))
        return F.struct(points.alias("points"), F.size(m).alias("hits"), F.concat_ws(",", F.transform(m, lambda x: x["code"])).alias("codes"))

    return once(F.lower(text), lambda low: once(met(low), told))


def _rank(c: str) -> Column:
    x = F.coalesce(c, F.lit("internal"))
    return F.when(x == "public", 0).when(x == "internal", 1).when(x == "pii_redacted", 2).when(x.isin("pii", "pci"), 3).when(x == "mnpi", 4).otherwise(1)


def detect_deviation(rows: DataFrame) -> DataFrame:
    """rows with deviation (codes) and deviation_points: in_pii, out_pii (arrays of categories, one a finding), classes, tokens, capability, response_kind."""
    more = F.size("out_pii") - F.size("in_pii")
    fresh = F.size(F.array_except("out_pii", "in_pii")) > 0
    checks = [
        (fresh | (more >= 3), "pii_introduced_in_response", 60),
        (~fresh & (more > 0) & (more < 3), "pii_introduced_in_response", 35),
        (F.coalesce(F.col("output_class") == "public", F.lit(False)) & (F.size("out_pii") > 0), "pii_leaked_to_public_surface", 60),
        (F.coalesce((F.col("capability") == "code-completion") & (F.col("response_kind") == "prose"), F.lit(False)), "capability_mismatch", 35),
        (F.coalesce((F.col("input_tokens") > 0) & (F.col("output_tokens") > 30 * F.col("input_tokens")), F.lit(False)), "output_disproportionate", 15),
        (_rank("output_class") < _rank("input_class"), "response_classification_lower_than_input", 35),
    ]
    met = F.filter(F.array(*[F.when(m, F.struct(F.lit(c).alias("code"), F.lit(w).alias("w"))) for m, c, w in checks]), lambda x: x.isNotNull())
    return rows.withColumn("deviation", F.transform(met, lambda x: x["code"])).withColumn("deviation_points", F.least(F.lit(100), F.aggregate(met, F.lit(0), lambda a, x: a + x["w"])))


def detect_shadow_ai(rows: DataFrame, vendors: list[str], models: list[str], sources: list[str], providers: list[str] | None = None, consumer: list[str] = CONSUMER) -> DataFrame:
    """rows with shadow (codes) and shadow_points: vendor, model, app, provider, endpoint_url. Blank metadata is a finding."""
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    host = F.lower(F.expr("try_parse_url(endpoint_url, 'HOST')"))
    at_consumer = F.array_contains(F.array(*[F.lit(d) for d in consumer]), host)
    for d in consumer:
        at_consumer = at_consumer | host.endswith("." + d)
    checks = [
        (~given("vendor"), "vendor_metadata_missing", 25),
        (given("vendor") & ~F.col("vendor").isin(*vendors), "vendor_not_approved", 20),
        (~given("model"), "model_metadata_missing", 25),
        (given("model") & ~F.col("model").isin(*models), "model_not_approved", 15),
        (~given("app"), "source_metadata_missing", 25),
        (given("app") & ~F.col("app").isin(*sources), "source_not_approved", 25),
        (given("provider") & ~F.col("provider").isin(*providers) if providers else F.lit(False), "provider_not_approved", 15),
        (given("endpoint_url") & host.isNull(), "endpoint_unparseable", 50),
        (given("endpoint_url") & F.coalesce(at_consumer, F.lit(False)), "consumer_endpoint", 50),
    ]
    met = F.filter(F.array(*[F.when(m, F.struct(F.lit(c).alias("code"), F.lit(w).alias("w"))) for m, c, w in checks]), lambda x: x.isNotNull())
    return rows.withColumn("shadow", F.transform(met, lambda x: x["code"])).withColumn("shadow_points", F.least(F.lit(100), F.aggregate(met, F.lit(0), lambda a, x: a + x["w"])))


def safety_verdict(rows: DataFrame, block_at: int = 70, flag_at: int = 30) -> DataFrame:
    """rows (of detect_shadow_ai and detect_deviation, with in_sure, out_sure) with risk (0 to 1, 3 digits), verdict, codes."""
    points = 50 * F.col("shadow_points") + 35 * F.col("deviation_points") + F.when(F.col("out_sure"), 2500).otherwise(0) + F.when(F.col("in_sure"), 1000).otherwise(0)
    risk = F.least(F.lit(10000), points)
    blind = F.arrays_overlap("shadow", F.array(*[F.lit(x) for x in ("vendor_metadata_missing", "model_metadata_missing", "source_metadata_missing", "endpoint_unparseable")]))
    hard = F.array_contains("shadow", "consumer_endpoint") | blind | F.array_contains("deviation", "pii_leaked_to_public_surface")
    verdict = F.when(hard | (risk >= 100 * block_at), "block").when(risk >= 100 * flag_at, "flag").otherwise("allow")
    codes = F.concat(F.transform("shadow", lambda x: F.concat(F.lit("shadow:"), x)), F.transform("deviation", lambda x: F.concat(F.lit("deviation:"), x)))
    return rows.withColumn("risk", F.floor(risk / 10.0 + 0.5) / 1000.0).withColumn("verdict", verdict).withColumn("codes", F.concat_ws(",", codes))
