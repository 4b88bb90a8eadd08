"""Mixes sources to target weights by Efraimidis-Spirakis sampling.

Targets. Each source's share of the budget follows its weight; a target stops at `epochs` times the source's size, and
the excess is shared again by weight until none is above. That fixed point is a water level: with sources in order of
cap / weight, level = (budget - caps of those before) / (weights from here on) at the first source whose cap isn't
reached. One window over the table of sources finds it.

Sampling. The key of a document is -ln(u) / weight with u drawn from its id, so that sorting by key is a weighted sample
without replacement, and reruns agree. Complete epochs take every document; the rest of a target takes documents in key
order while the middle of a document lies below it, so a source misses its target by half a document at most.

Running totals. Keys are cut into cells by their logarithm. That of -ln(u) has a density of 1/e at most, and dividing by a
weight only shifts it, so cells of equal width hold CELL documents of a source each at most on average, whatever the
weights are; most cells far out are empty and cost nothing. Cell totals are summed by source, and only documents of one cell are sorted together. A source with a
third of all rows is as many cells as its size asks for; its cells' totals are one row each.

Cases: null, empty and blank texts have size 0 and are taken 0 words; a null source is a source and sorts last; a null
doc_id draws its key from the text; equal keys (rows that repeat in full) are ordered by doc_id and text hash, and are
taken one by one; a source whose documents are all
empty has target 0; a weight that is null, zero or negative counts as the least weight; further columns are ignored; no
rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed, word_array, written

WEIGHTS = (5, 2, 1)
SHARE_PERCENT, EPOCHS = 150, 2
CELL = 1024
LEAST_WEIGHT = 1e-3


def uniform(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A number above 0 and below 1 from 52 bits of an MD5 of the doc_id, or of the text where that is null."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weight(text: Column) -> Column:
    """The share of characters that aren't markup symbols; 1 for empty texts."""
    n = F.length(text)
    bare = F.when(text.rlike(r"[#*$%&|<>]"), F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).otherwise(n)
    return F.when(n > 0, bare / n).otherwise(F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from source, source_size (one row for each source)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    capped = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * (percent / 100)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = capped.withColumn("level", level)
    first_open = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    target = F.coalesce(F.least(F.col("cap"), first_open * F.col("weight")), F.col("cap"))
    return levelled.withColumn("target", F.greatest(target, F.lit(0.0))).select("source", "source_size", "target")


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """_id, _th, doc_id, source, size, key for each row of docs (doc_id, text, source)."""
    text = F.col("text")
    w = F.greatest(F.coalesce(quality_weight(text) if weight is None else weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    rows = keyed(docs, F.col("source").cast("string").alias("source"))
    size = F.size(word_array(F.coalesce(text, F.lit("")))).cast("long")
    return rows.select("_id", "_th", "doc_id", "source", size.alias("size"), (-F.log(uniform(F.col("doc_id"), F.col("text"))) / w).alias("key"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = EPOCHS, weight: Column | None = None) -> DataFrame:
    """_id, _th, doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source)."""
    rows = written(sized(docs, weight))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    goal = targets(sources.select("source", "source_size"), weights, percent, epochs)
    goal = goal.join(sources.select(F.col("source").alias("s"), "documents"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = written(goal.withColumn("cells", F.ceil(F.col("documents") / CELL)))
    known = goal.select(F.col("source").alias("_source"), "source_size", "target", "cells")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("cell", F.floor(F.log("key") * F.col("cells") / math.e))
    totals = placed.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("source").alias("_source"), F.col("cell").alias("_cell"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "cell").orderBy("key", F.col("doc_id").asc_nulls_last(), "_th").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    based = summed.join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    more = (F.col("base") + F.col("within") + F.col("size") / 2.0 < rest).cast("int")
    copies = F.when(F.col("size") > 0, whole + more).otherwise(F.lit(0)).cast("long")
    return based.withColumn("copies", copies).select(
        "_id", "_th", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def op6(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null' || coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / greatest(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[#*$%&|<>]+', '', 'g'))::DOUBLE / length(text) ELSE 1.0::DOUBLE END, 0.001::DOUBLE) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, (2 * source_size)::DOUBLE AS cap
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, greatest(coalesce(least(cap, max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight), cap), 0) AS target
  FROM levels),
placed AS (
  SELECT r.*, g.source_size, g.target,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN size > 0 THEN whole + CASE WHEN before + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END ELSE 0 END * size)::BIGINT AS taken
FROM placed
"""
