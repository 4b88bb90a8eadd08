"""Quality rules whose cutoffs are chosen on labelled holdouts with exact binomial bounds. DataFrame functions only.

Measures are made from the whole text. A rule rejects a document whose measure exceeds the cutoff of its stratum. The
holdout (the distinct texts of labelled documents that pass the base rules; copies are no further trials of a bound) gives
the number n of a stratum's good documents. Rules are taken in
the order of GRIDS; a rule's cutoffs are tested from the loosest to the tightest, and each test counts the k good documents
that the cutoff rejects together with the cutoffs which the rules before it use. If the true false-rejection rate of that
union were above RISK, k or fewer rejections would have at most the probability P(Bin(n, RISK) <= k), summed exactly; the
cutoff is certified where that p-value is at most ALPHA / (strata x rules x ways). k only grows along a rule's cutoffs, so
the certified ones are the first of the chain, and a chain needs one share of ALPHA, not one for each cutoff. ways is the
number of choices that the rules before could have made (the chain depends on their choice): candidate cutoffs plus one
each, multiplied; 1 for the first rule. A candidate rejects more bad documents than the next looser cutoff; that depends
on the bad documents alone, so on nothing that the tests count. Among its certified candidates a rule uses that which adds
most bad holdout documents less good ones (the largest on a tie); one that has none, or never adds more bad than good
ones, rejects nothing in that stratum. So, with confidence 1 - ALPHA, no stratum loses more than RISK of its good
documents, whatever the measures are worth; few labels mean no rejections (a clean cutoff of the first rule needs 286 good
documents with four strata).

Cases: null, empty and blank texts have no words and fail the base rules; a null stratum is a stratum; documents without
a label, labels without a document and null labels are not in the holdout; a text with several
labels, by its copies or its own, counts once, as good if any label says so; rows that repeat are judged alike; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keyed, word_array, written

#: The rules' measures and their cutoffs, the least first.
GRIDS = {
    "symbol_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "dup_line_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeat_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4],
    "long_words": [9.0, 10.0, 11.0, 12.0, 14.0, 18.0, 25.0],
}
RISK, ALPHA = 0.02, 0.05
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words inside 3-word windows found twice or more: sort (hash, place), keep equal neighbours, add up what each covers."""
    grams = F.transform(F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.struct(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")))
    return F.sort_array(grams)


def measures(docs: DataFrame, *more: str) -> DataFrame:
    """_id, _th, _text (a hash of the text), doc_id, `more`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed for each row."""
    rows = keyed(docs, *more).withColumn("_text", F.xxhash64("text"))
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = text
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    base = ["_id", "_th", "_text", "doc_id", *more]
    one = rows.select(
        *base,
        word_array(text).alias("w"),
        lines.alias("lines"),
        F.when(text.rlike(r"[#*$%&|<>]"), F.length(text) - F.length(bare)).otherwise(0).alias("n_symbols"),
    )
    two = one.select(
        *base,
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"),
    )
    three = two.withColumn("grams", _repeat_words(F.col("hashes"), F.col("n"))).drop("hashes")

    def again(x: Column, j: Column) -> Column:
        h = x["h"]
        return (h == F.get("grams", j + 1)["h"]) | ((j > 0) & (h == F.get("grams", F.greatest(j - 1, F.lit(0)))["h"]))

    at = F.sort_array(F.transform(F.filter("grams", lambda x, j: F.coalesce(again(x, j), F.lit(False))), lambda x: x["i"]))
    four = three.withColumn("at", at).drop("grams")
    covers = F.transform("at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - x, F.lit(3))))
    repeat = F.aggregate(covers, F.lit(0), lambda total, x: total + x)
    five = four.select(
        *base,
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return five.withColumn("base_failed", failed)


def _shares() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), by adding terms made from each other in logarithms; 1 once k passes the mean."""
    step = F.sequence(F.lit(0).cast("long"), k)
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(
        step,
        start,
        lambda a, i: F.struct((a["t"] + F.log((n - i).cast("double") / (i + 1)) + odds).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """stratum, rule, cutoff: the certified cutoff that each rule uses in each stratum, where there is a useful one.

    measured: rows of `measures` with the stratum's column. labels: doc_id, quality (1 is good, 0 bad). Holdout rows are
    counted by stratum and the cutoffs that they pass (at most 5,184 cells a stratum) before they are shuffled; the result
    has strata x rules rows at most.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    shares = _shares()
    levels = [sum((F.when(shares[r] > cut, 1).otherwise(0) for cut in grid), F.lit(0)).alias(f"l{j}") for j, (r, grid) in enumerate(GRIDS.items())]
    at = [f"l{j}" for j in range(len(GRIDS))]
    held = measured.where("not base_failed").join(known, "doc_id").select("_text", "good", F.col(stratum).cast("string").alias("stratum"), *levels)
    held = held.groupBy("stratum", "_text", *at).agg(F.max("good").alias("good"))  # a text is one trial, however often it stands
    cells = written(held.groupBy("stratum", *at).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")))
    bad = [F.sum(F.when(F.col(f"l{j}") > i, F.col("b")).otherwise(0)).alias(f"b{j}_{i}") for j, grid in enumerate(GRIDS.values()) for i in range(len(grid))]
    state = cells.groupBy("stratum").agg(F.sum("g").alias("n"), *bad).withColumn("ways", F.lit(1.0)).join(F.broadcast(cells.agg(F.count_distinct(F.struct("stratum")).alias("strata"))))
    for j, (rule, grid) in enumerate(GRIDS.items()):
        state = written(_chosen(cells, state, j, rule, grid, risk, alpha))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.get(F.lit(grid), F.col(f"c{j}")).alias("cutoff")) for j, (r, grid) in enumerate(GRIDS.items())]))
    return state.select("stratum", each.alias("x")).select("stratum", "x.*").where("cutoff is not null")


def _chosen(cells: DataFrame, state: DataFrame, j: int, rule: str, grid: list[float], risk: float, alpha: float) -> DataFrame:
    """state (a row a stratum) with c<j>, the place in the grid of the cutoff that rule j uses or null, and ways for the next rule."""
    taken = F.lit(False)
    for i in range(j):
        taken = taken | F.coalesce(F.col(f"l{i}") > F.col(f"c{i}"), F.lit(False))
    hit = lambda i: F.when(~F.col("taken") & (F.col(f"l{j}") > i), F.col("g")).otherwise(0)
    new = lambda i: F.when(~F.col("taken") & (F.col(f"l{j}") > i), F.col("b")).otherwise(0)
    sums = [F.sum(f(i)).alias(f"{name}{i}") for i in range(len(grid)) for name, f in (("k", hit), ("d", new))]
    joined = cells.withColumnRenamed("stratum", "_s").join(F.broadcast(state), F.col("_s").eqNullSafe(F.col("stratum"))).withColumn("taken", taken)
    summed = joined.groupBy(*state.columns).agg(F.sum(F.when(F.col("taken"), F.col("g")).otherwise(0)).alias("before"), *sums)
    looser = [F.col(f"b{j}_{i + 1}") if i + 1 < len(grid) else F.lit(0) for i in range(len(grid))]
    better = [F.col(f"b{j}_{i}") > looser[i] for i in range(len(grid))]
    level = F.lit(alpha) / (F.col("strata") * len(GRIDS) * F.col("ways"))
    options = []
    for i in range(len(grid)):
        sure = binomial_tail(F.col("n"), F.col("before") + F.col(f"k{i}"), risk) <= level
        gain = F.col(f"d{i}") - F.col(f"k{i}")
        options.append(F.when(better[i] & (gain > 0) & sure, F.struct(gain.alias("gain"), F.lit(i).alias("i"))))
    best = F.array_max(F.array(*options))["i"]
    more = sum((F.when(x, 1).otherwise(0) for x in better), F.lit(1))
    return summed.select(*[c for c in state.columns if c != "ways"], best.alias(f"c{j}"), (F.col("ways") * more).alias("ways"))


def judged(measured: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """measured with kept and, for rejected rows, the rules that reject it. The cutoffs: one row a stratum, strata are few."""
    wide = cuts.groupBy("stratum").pivot("rule", list(GRIDS)).agg(F.min("cutoff"))
    wide = wide.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in GRIDS])
    joined = measured.join(wide, F.col(stratum).cast("string").eqNullSafe(F.col("_stratum")), "left")
    over = [F.when(c > F.col(f"_{r}"), F.lit(r)) for r, c in _shares().items()]
    rules = F.filter(F.array(F.when(F.col("base_failed"), F.lit("base")), *over), lambda x: x.isNotNull())
    return joined.withColumn("rejected_by", rules).withColumn("kept", F.size("rejected_by") == 0).drop("_stratum", *[f"_{r}" for r in GRIDS])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """The measures of each row with base_failed, rejected_by and kept. Texts are read once; their measures are a written table."""
    measured = written(measures(docs, stratum))
    return judged(measured, cutoffs(measured, labels, stratum, risk, alpha), stratum)


def op2(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
